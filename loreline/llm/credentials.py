"""Credentials embedded in texts: finding them, and masking only them.

A keyword automaton reads every text once; only where a keyword stands are the expressions tried, issuer formats first,
then the places in which credentials stand (assignments, headers, flags, URLs, connection strings). What is found is
validated: a token with an issuer's checksum is one if that holds, a signed token must have a readable header, others must
look drawn at random, an encoded pair must decode to one, a private key must hold enough base64. Placeholders, masked or empty values and references to variables, files or stores are none.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How issuers' credentials begin, in lower case, and what they look like; where a length is not fixed by the issuer it is a range.
ISSUERS = {
    "gho_": r"gho_[A-Za-z0-9]{36,251}",
    "ghp_": r"ghp_[A-Za-z0-9]{36,251}",
    "ghr_": r"ghr_[A-Za-z0-9]{36,251}",
    "ghs_": r"ghs_[A-Za-z0-9]{36,251}",
    "ghu_": r"ghu_[A-Za-z0-9]{36,251}",
    "github_pat_": r"github_pat_[A-Za-z0-9_]{60,250}",
    "glpat-": r"glpat-[A-Za-z0-9_-]{20,300}(?:\.[a-z0-9]{2}\.[a-z0-9]{9})?",
    "gldt-": r"gldt-[A-Za-z0-9_-]{20,64}",
    "glptt-": r"glptt-[A-Za-z0-9_-]{20,64}",
    "glrt-": r"glrt-[A-Za-z0-9_-]{20,64}",
    "sk_live_": r"sk_live_[A-Za-z0-9]{16,247}",
    "sk_test_": r"sk_test_[A-Za-z0-9]{16,247}",
    "rk_live_": r"rk_live_[A-Za-z0-9]{16,247}",
    "rk_test_": r"rk_test_[A-Za-z0-9]{16,247}",
    "whsec_": r"whsec_[A-Za-z0-9+/]{24,64}={0,2}",
    "xox": r"xox[abeoprs]-(?:[0-9]{8,14}-){1,3}[A-Za-z0-9]{20,64}",
    "xapp-": r"xapp-[0-9]-[A-Z0-9]{9,12}-[0-9]{10,14}-[a-f0-9]{64}",
    "akia": r"AKIA[A-Z0-9]{16}",
    "asia": r"ASIA[A-Z0-9]{16}",
    "aiza": r"AIza[A-Za-z0-9_-]{35}",
    "ya29.": r"ya29\.[A-Za-z0-9_-]{30,300}",
    "gocspx-": r"GOCSPX-[A-Za-z0-9_-]{28}",
    "npm_": r"npm_[A-Za-z0-9]{36}",
    "pypi-ageichlwa": r"pypi-AgEIcHlwa[A-Za-z0-9_-]{50,300}",
    "rubygems_": r"rubygems_[a-f0-9]{48}",
    "dckr_pat_": r"dckr_pat_[A-Za-z0-9_-]{24,40}",
    "sg.": r"SG\.[A-Za-z0-9_-]{16,32}\.[A-Za-z0-9_-]{32,64}",
    "xkeysib-": r"xkeysib-[a-f0-9]{64}-[A-Za-z0-9]{16}",
    "shpat_": r"shpat_[A-Fa-f0-9]{32}",
    "shpss_": r"shpss_[A-Fa-f0-9]{32}",
    "shpca_": r"shpca_[A-Fa-f0-9]{32}",
    "dop_v1_": r"dop_v1_[a-f0-9]{64}",
    "doo_v1_": r"doo_v1_[a-f0-9]{64}",
    "dapi": r"dapi[a-f0-9]{32}(?:-[0-9])?",
    "hvs.": r"hvs\.[A-Za-z0-9_-]{24,300}",
    "hf_": r"hf_[A-Za-z]{34}",
    "glsa_": r"glsa_[A-Za-z0-9]{32}_[A-Fa-f0-9]{8}",
    "lin_api_": r"lin_api_[A-Za-z0-9]{40}",
    "nrak-": r"NRAK-[A-Z0-9]{27}",
    "pmak-": r"PMAK-[a-f0-9]{24}-[a-f0-9]{34}",
    "sk-": r"sk-(?:[a-z0-9]{2,10}-)*[A-Za-z0-9_]{32,200}",
    ":aa": r"[0-9]{8,10}:AA[A-Za-z0-9_-]{33}",
    "age-secret-key-1": r"AGE-SECRET-KEY-1[0-9A-Z]{58}",
    "eyj": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
}
# Words that make the name of something a key, and calls whose third argument is a password.
KEY_WORDS = ["api", "access", "secret", "signing", "private", "deploy", "auth", "encryption", "client"]
CALLS = ["connect", "login", "auth", "open", "dial"]
SECRET_WORDS = ["password", "passwd", "passphrase", "pass", "pwd", "pw", "secret", "token", "credential"]
# Substrings, in lower case, without which a text holds nothing that the expressions below match: all that these begin with or need.
KEYWORDS = [*SECRET_WORDS, *[w + sep + "key" for w in KEY_WORDS for sep in ("", "_", "-", " ")], *CALLS, "bearer", "basic", "x-auth", "x-api", "://", "-u", "--user", *ISSUERS]

#: What ends the name of something that holds a credential.
_NAME = r"(?:passw(?:or)?d|passphrase|(?-i:(?<![A-Za-z])(?:pass|Pass|PASS|pwd?|Pwd?|PWD?)|(?<=[a-z])(?:Pass|Pwd?))|secret|token|(?:secret[_-]?)?access[_-]?key(?:[_-]?id)?|(?:" + "|".join(KEY_WORDS) + r")[_-]?key|credentials?)"
_ISSUED = re.compile(r"(?<![A-Za-z0-9_/+.-])(?:" + "|".join(ISSUERS.values()) + r")(?![A-Za-z0-9_/+-])")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----(.*?)-----END \1-----", re.S)
_ASSIGNED = re.compile(
    r"(?i)(?<![A-Za-z0-9])(?P<name>[\w.-]*?" + _NAME + r")(?P<q>[\"']?)(?P<sep>[ \t]*(?::[ \t]*[&\w<>' ]{1,24}?[ \t]*=|:=|=>|=|:)[ \t]*)(?:\"(?P<d>[^\"\n]*)\"|'(?P<s>[^'\n]*)'|`(?P<t>[^`\n]*)`|(?P<bare>[^\s\"'`,;<>(){}\[\]][^\s\"'`,;]*))"
)
_LISTED = re.compile(r"(?i)name:[ \t]*[\"']?[\w.-]*?" + _NAME + r"[\"']?[ \t]*\r?\n[ \t]*value:[ \t]*(?:\"(?P<d>[^\"\n]*)\"|'(?P<s>[^'\n]*)'|(?P<bare>[^\s\"'#]+))")
_HEADER = re.compile(r"(?i)\b(?P<scheme>bearer|basic)[ \t]+(?P<v>[A-Za-z0-9._~+/-]{6,}=*)")
_CUSTOM = re.compile(r"(?i)\bx-(?:auth|api)[\w-]*[\"']?[ \t]*[:=][ \t]*[\"']?(?P<v>[^\s\"',;]+)")
_FLAG = re.compile(r"(?i)(?<![\w-])--(?:[\w-]*-)?" + _NAME + r"(?:[ \t]+|=)[\"']?(?P<v>[^\s\"',;]+)")
_USER = re.compile(r"(?i)(?<![\w-])(?:-u|--user)[ \t=]+[\"']?[\w.@-]+:(?P<v>[^\s\"']+)")
_URL = re.compile(r"(?i)\b[a-z][a-z0-9+.-]*://(?P<user>[^\s:/@\"'<>]*):(?P<v>[^\s/@\"'<>]+)@(?=[\w.\[-])")
_CALL = re.compile(r"(?i)\b(?:" + "|".join(CALLS) + r")\w*\(\s*[\"'][^\"'\n]*[\"']\s*,\s*[\"'][^\"'\n]*[\"']\s*,\s*(?:\"(?P<d>[^\"\n]*)\"|'(?P<s>[^'\n]*)')")
_SAID = re.compile(r"(?i)(?<![A-Za-z0-9])[\w-]*?" + _NAME + r"[ \t]+(?P<v>[A-Za-z0-9+/_.~!@#%^&*-]{8,}=*)(?![\w(])")

# What stands where a credential has yet to be put.
_PLACEHOLDER = re.compile(r"(?i)(?:.*\b(?:your|my)[_ -].*|.*[_ -]here|change[_-]?(?:me|it)\W*|replace[_-]?(?:me|this)\W*|replace_.*|placeholder|example|sample|redacted|masked|hidden|removed|dummy|todo|fixme|none|null|nil|undefined|true|false|test|secret|password|passwd|pass|token|key|value|string|n/?a|tbd|x{3,}|\*+|\.{2,}|-+|…|required|optional|unset|empty)$")
_REFERENCE = re.compile(r"\$|%\(|%[A-Za-z_]+%|\{\{|<[^>]*>$|\[|.*\($|.*\(.*\)|(?:os|process|env|ctx|cfg|config|conf|settings|self|this|vault|secrets?|ssm|keyring|args|opts|options|params|req|request|system)[.:/]|(?:https?|file|arn|vault)[:/]")
_PATH = re.compile(r"(?:~|\.{0,2})/?(?:[a-z0-9_.-]+/)+[a-z0-9_.-]*$|/[\w./-]*$")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*$")
_CONSTANT = re.compile(r"[A-Z]+(?:_[A-Z]+)+$")
_WORD = re.compile(r"[A-Za-z]+$")
_PASSWORD = re.compile(r"(?i)(?:pass\w*|pwd?)$")
_PHRASE = re.compile(r"[a-z]+(?:-[a-z]+){3,}$")


# Words that make a value of several words a sentence about a password rather than one.
_SPOKEN = re.compile(r"(?i)\b(?:a|an|and|are|at|be|blank|cannot|change|characters?|choose|confirm|empty|enter|field|for|forgot|from|if|in|incorrect|invalid|is|it|keys?|least|match(?:es)?|minimum|missing|must|new|no|not|of|or|passwords?|please|prompt|required|reset|secrets?|should|the|this|to|tokens?|type|use|with|wrong|you|your)\b")


def _is_value(v: str) -> bool:
    """Whether a value that stands for a credential is one, and not a placeholder, a masked value or a reference."""
    if len(v) < 4 or " " in v or len(set(v)) < 3:
        return False
    return _is_meant(v)


def _is_meant(v: str) -> bool:
    """Whether a value is none of what stands where a credential has yet to be put, is masked, or refers to one elsewhere."""
    if _PLACEHOLDER.match(v) or _REFERENCE.match(v) or _CONSTANT.match(v) or "*****" in v:
        return False
    return not (_PATH.match(v) and ("/" in v and not re.search(r"[A-Z].*[0-9]|[0-9].*[A-Z]", v)))


def _is_password(v: str) -> bool:
    """Whether a quoted value of something named a password is one, however weak: of any length and with blanks, but no sentence about passwords."""
    if not re.search(r"\w", v) or not _is_meant(v):
        return False
    return " " not in v or (v == v.strip() and not _SPOKEN.search(v) and not re.search(r"[.!?:,]( |$)|  ", v))


def _is_random(v: str) -> bool:
    """Whether a part of a value looks drawn at random: at least twelve letters and digits in a row of all three kinds, or with many changes of kind."""
    for part in re.findall(r"[A-Za-z0-9]{12,}", v):
        kinds = [0 if c.isdigit() else 1 if c.islower() else 2 for c in part]
        changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
        if changes * 4 >= len(part) and len(set(kinds)) > 1:
            return True
    return False


def _is_strong(v: str) -> bool:
    """Whether a value is a credential by its looks alone: long with letters and digits, or several joined words."""
    if re.search(r"\.(?:py|js|ts|go|rs|java|md|txt|ya?ml|json|toml|sh|html?|css)\b", v):
        return False
    return bool(_PHRASE.match(v)) or bool(re.search(r"[0-9]", v) and re.search(r"[A-Za-z]", v) and (len(v) >= 16 and (not re.search(r"[._]", v) or _is_random(v)) or _ISSUED.match(v) or re.search(r"[!#%&*]", v)))


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_holds(v: str) -> bool | None:
    """Whether the checksum that an issuer puts into its tokens is right; null for tokens without one.

    Six base-62 digits of the CRC-32 of what stands between the prefix and them, or eight hexadecimal ones.
    """
    if re.fullmatch(r"(?:gh[oprsu]|npm)_[A-Za-z0-9]{36}", v):
        body, n, tail = v[4:-6], 0, ""
        n = zlib.crc32(body.encode())
        for _ in range(6):
            n, digit = divmod(n, 62)
            tail = _BASE62[digit] + tail
        return tail == v[-6:]
    if v.startswith("glsa_"):
        return f"{zlib.crc32(v[:-9].encode()):08x}" == v[-8:].lower()
    return None


def _is_issued(v: str) -> bool:
    """Whether what has an issuer's format is a token: by its checksum, its header, or, where neither tells, by looking drawn at random."""
    if v.startswith("eyJ"):
        return _is_signed(v)
    if checksum_holds(v):
        return True
    if re.search(r"(?i)example|(.)\1{5}|abcdefgh", v):
        return False
    rest = re.sub(r"^[A-Za-z0-9]{2,6}[_.-](?:[a-z]+[_-])?", "", v)
    mixed = re.search(r"[0-9]", rest) and re.search(r"[A-Za-z]", rest)
    return len(set(rest)) >= 8 and bool(mixed or v.startswith(("AKIA", "ASIA", "hf_")))  # these may be without digits


def _is_pair(v: str) -> bool:
    try:
        user, colon, word = base64.b64decode(v, validate=True).decode("utf-8").partition(":")
    except (binascii.Error, ValueError):
        return False
    return bool(user and colon and user.isprintable() and word.isprintable() and _is_value(word))


def _is_signed(v: str) -> bool:
    head = v.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError, TypeError):
        return False


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k in KEYWORDS:
        a.add_word(k, len(k))
    a.make_automaton()
    return a


class Finder:
    """Finds credentials as (start, end) in texts, leftmost first, none within another."""

    def __init__(self) -> None:
        self._keywords = _automaton()

    def _regions(self, text: str) -> list[tuple[int, int]]:
        """Lines that hold a keyword, with the line after them, as disjoint parts of the text."""
        low = text.lower()
        if len(low) != len(text):  # a few letters grow when lower-cased
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        regions: list[tuple[int, int]] = []
        upto = -1
        for end, _ in self._keywords.iter(low):
            if end < upto:
                continue
            start = text.rfind("\n", 0, end) + 1
            stop = text.find("\n", end)
            upto = len(text) if stop < 0 else stop
            after = text.find("\n", upto + 1) if stop >= 0 else -1
            after = after if after >= 0 else len(text)
            if regions and start <= regions[-1][1]:
                regions[-1] = (regions[-1][0], after)
            else:
                regions.append((start, after))
        return regions

    def spans(self, text: str, code: bool = False) -> list[tuple[int, int]]:
        """code: whether unquoted words on the right of an assignment are names rather than values."""
        regions = self._regions(text)
        if not regions:
            return []
        found: list[tuple[int, int, int]] = []
        if "PRIVATE KEY" in text:
            for m in _PEM.finditer(text):
                body = re.sub(r"\\[nrt]|\s", "", m[2])
                if len(re.sub(r"[^A-Za-z0-9+/=]", "", body)) >= 64:
                    found.append((0, m.start(), m.end()))
        for a, b in regions:
            for m in _ISSUED.finditer(text, a, b):
                if _is_issued(m[0]):
                    found.append((1, m.start(), m.end()))
            for m in _ASSIGNED.finditer(text, a, b):
                g = m.lastgroup
                v = m[g]
                if g != "bare":
                    ok = _is_value(v) or (bool(_PASSWORD.search(m["name"])) and _is_password(v))
                else:
                    spaced = m["sep"][:1] in " \t" or m["sep"][-1:] in " \t"
                    ok = _is_value(v) and not (code and spaced and (_IDENTIFIER.match(v) or not _is_strong(v))) and not (v.endswith("]") or "(" in v)
                    v = v.rstrip(")}")
                if ok and _WORD.match(v) and not _PASSWORD.search(m["name"]):
                    ok = False  # a plain word may be a password in use, but no issued key
                if ok and v.split(" ")[0].lower() not in ("bearer", "basic"):  # a scheme's name is followed by the credential, which is found by itself
                    found.append((3, m.start(g), m.start(g) + len(v)))
            for m in _LISTED.finditer(text, a, b):
                if _is_value(m[m.lastgroup]):
                    found.append((3, m.start(m.lastgroup), m.end(m.lastgroup)))
            for m in _HEADER.finditer(text, a, b):
                if _is_pair(m["v"]) if m["scheme"].lower() == "basic" else _is_value(m["v"]) and _is_strong(m["v"]):
                    found.append((2, m.start("v"), m.end("v")))
            for p in (_CUSTOM, _FLAG, _USER):
                for m in p.finditer(text, a, b):
                    if _is_value(m["v"]) and m["v"].lower() not in ("bearer", "basic"):
                        found.append((4, m.start("v"), m.end("v")))
            for m in _URL.finditer(text, a, b):
                if _is_value(m["v"]) and (m["user"].lower(), m["v"].lower()) not in (("user", "pass"), ("user", "password"), ("username", "password")):
                    found.append((2, m.start("v"), m.end("v")))
            for m in _CALL.finditer(text, a, b):
                if _is_value(m[m.lastgroup]) or _is_password(m[m.lastgroup]):
                    found.append((4, m.start(m.lastgroup), m.end(m.lastgroup)))
            for m in _SAID.finditer(text, a, b):
                if _is_value(m["v"]) and _is_strong(m["v"]):
                    found.append((5, m.start("v"), m.end("v")))
        out: list[tuple[int, int]] = []
        for _, s, e in sorted(set(found)):
            if all(e <= x or s >= y for x, y in out):
                out.append((s, e))
        return sorted(out)


# A letter that stands for all of its script, small and capital where there are both.
_SCRIPTS = {"LATIN": "áÁ", "GREEK": "αΑ", "CYRILLIC": "аА", "HEBREW": "א", "ARABIC": "ا", "DEVANAGARI": "अ", "THAI": "ก", "HIRAGANA": "あ", "KATAKANA": "ア", "HANGUL": "가", "CJK": "一"}
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_BASE32 = re.compile(r"[A-Z2-7]+")


def _cover(text: str) -> str:
    """As long, in the same alphabet: hexadecimal stays so, and so do base 32, 58, 62 and 64; letters become x, digits 0, all else stays; a key's first and last line stay."""
    m = _PEM.fullmatch(text)
    if m:
        return text[: m.start(2)] + re.sub(r"(\\[nrt])|[a-z]|[A-Z]|[0-9]", lambda c: c[1] or _blank(c[0]), m[2]) + text[m.end(2) :]
    return re.sub(r"[^\W_]+", lambda run: _covered(run[0]), text)


def _covered(run: str) -> str:
    """A run of letters and digits in its own alphabet."""
    if len(run) >= 8 and _HEX.fullmatch(run):
        return "".join("0" if c.isdigit() else "A" if c.isupper() else "a" for c in run)
    if len(run) >= 8 and _BASE32.fullmatch(run):
        return "".join("2" if c.isdigit() else "A" for c in run)
    return "".join(_blank(c) for c in run)


def _blank(c: str) -> str:
    if c.isascii():
        return "0" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
    letters = _SCRIPTS.get(unicodedata.name(c, "").split(" ")[0].split("-")[0])
    return c if letters is None else letters[-1] if c.isupper() else letters[0]


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for s, e in spans:
        parts += [text[at:s], _cover(text[s:e])]
        at = e
    return "".join([*parts, text[at:]])


#: Endings of paths whose unquoted words are names of variables.
CODE_ENDINGS = (".py", ".js", ".ts", ".go", ".java", ".rs", ".c", ".cpp", ".cs", ".rb", ".php", ".kt", ".scala", ".swift", ".tsx", ".jsx")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", all_rows: bool = False) -> DataFrame:
    """(id, secrets, masked): the distinct credentials of every text that holds any, in order, and the text with only their places masked.

    Texts without a credential give no row, nor do null, empty or blank texts and null ids; with all_rows every row gives
    one, without secrets where there are none, and its text as it is. path may be null; it only tells
    whether unquoted words are values. Masked texts are as long as before. Every row is looked at by itself, so
    repeated rows repeat their result and very long texts are scanned whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder()
        for batch in batches:
            out = []
            for i, text, path in zip(batch["id"].tolist(), batch["text"].tolist(), batch["path"].tolist(), strict=True):
                spans = finder.spans(text, bool(path) and path.strip().lower().endswith(CODE_ENDINGS)) if text is not None else []
                if spans or all_rows:
                    out.append((i, list(dict.fromkeys(text[s:e] for s, e in spans)), mask(text, spans) if spans else text))
            yield pd.DataFrame(out, columns=[id_col, "secrets", "masked"], dtype=object)

    path = F.col(path_col) if path_col in docs.columns else F.lit(None).cast("string")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("secrets", T.ArrayType(T.StringType())), T.StructField("masked", T.StringType())])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), path.alias("path"))
    return (rows if all_rows else rows.filter(F.col("id").isNotNull() & F.col("text").isNotNull())).mapInPandas(run, schema)
