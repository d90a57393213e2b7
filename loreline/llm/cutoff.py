"""Texts that were cut off before their end.

Intact texts are cut artificially to get cases, and a logistic regression on hashed features of how a text closes is
trained on both: its closing characters and words, what is still open, and how its length stands to the lengths at which
its source cuts. All rows are scored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreline.llm.tokens import same_spelling
from loreline.operators.joins import lookup_join
from loreline.session import cut

#: Hashed features.
DIMENSIONS = 1 << 15
#: Log odds beyond which a text given as intact is no example; endings that are rare but whole must stay below.
ODD = 1.5
# What is put after a cut.
MARKS = ["...[truncated]", "\n...[truncated]", "…", " […]", " [...]", "...", "[truncated]", "\n[message clipped]", " (truncated)", "<truncated>", "... (more)"]
_MARK = re.compile(r"\s*(?:(?:\.{3}|…)?\s*[\[(<]\s*(?:\.{3}|…|[^\])>\n]{0,20}(?:trunc|clip|cut|snip|omit|more)[^\])>\n]{0,20})\s*[\])>]|…)\s*$", re.I)
_TOKEN = re.compile(r"\s+|[\w$]+(?:[./\\-][\w$]+)*|[^\w\s]")
_MULTI = re.compile(r"[a-z0-9]_[a-z0-9]|[a-z][A-Z]|^[A-Z][a-z]+[A-Z]|^[A-Z]+_[A-Z]")
_SUBWORD = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+(?![^\W\d_A-Z])")
_CLOSERS = {"(": ")", "[": "]", "{": "}"}


def _shape(token: str) -> str:
    """A token with what varies taken out: names, numbers, paths and versions become one letter."""
    if token.isspace():
        return "\n" if "\n" in token else " "
    if token[0].isdigit():
        return "V" if "." in token else "N"
    if "/" in token or "\\" in token:
        return "P" + ("." + token.rsplit(".", 1)[1] if "." in token.rsplit("/", 1)[-1] else "")
    if _MULTI.search(token):
        return "I"
    return token.lower() if len(token) < 24 else "L"


def _bucket(n: int) -> int:
    return n if n < 3 else 3 + int(np.log2(n - 2))


def subwords(text: str) -> list[str]:
    """Runs of letters, split where the case rises."""
    return [w.lower() for w in _SUBWORD.findall(text)]


def at_limit(text: str, limits: Collection[int]) -> bool:
    """Whether the text is as long as its source allows, up to the rest of a character."""
    size, weight = len(text), len(text.encode("utf-8", "replace"))
    return any(0 <= m - x < 4 and (x == m or x == weight) for m in limits for x in (size, weight))


def surely_odd(text: str, n_chars: int | None, limits: Collection[int]) -> bool:
    """Whether a text may not serve as an intact one: marked, reported to be longer, or as long as its source allows without a closing mark."""
    reported = n_chars is not None and n_chars > len(text.encode("utf-8", "replace"))
    return bool(_MARK.search(text)) or reported or (at_limit(text, limits) and text.rstrip()[-1:] not in ".?!。`}")


def _hashed(features: list[str]) -> set[int]:
    return {zlib.crc32(x.encode("utf-8", "replace")) % DIMENSIONS for x in features}


def describe(text: str, kind: str, ending: str, n_chars: int | None, limits: Collection[int]) -> list[int]:
    """Hashed features of how a text closes, without what its last word tells."""
    return sorted(closing(text, kind, ending, n_chars, limits)[1])


def closing(text: str, kind: str, ending: str, n_chars: int | None, limits: Collection[int]) -> tuple[str | None, set[int], set[int], set[int]]:
    """The word a text ends in (null where it ends in none), hashed features of how it closes, those besides if the word is whole, and if it is not."""
    f: list[str] = []
    form = {"source_file": "code", "config_file": "conf", "failure_log": "log"}.get(kind, "prose")
    style = form + ending if form in ("code", "conf") else form
    marked = _MARK.search(text)
    body = text[: marked.start()] if marked else text
    if marked:
        f.append("mark")
    bare = body.rstrip()
    newline = body[len(bare) :].count("\n")
    blob = len(bare) > 400 and bare.count("\n") * 250 < len(bare)  # minified or data
    last_line = bare[bare.rfind("\n") + 1 :]
    shapes = [_shape(t) for t in _TOKEN.findall(last_line)]
    tight = [s for s in shapes if s != " "]
    end = bare[-1:]
    kind_of_end = end if end and not end.isalnum() else "cjk" if end > "⺀" else "digit" if end.isdigit() else "letter" if end else "none"
    f += [f"end {kind_of_end}", f"end {style} {kind_of_end} {newline > 0}", f"end {style} {blob} {newline > 0}"]
    for n in (1, 2, 3, 4):
        f.append(f"last{n} {form} " + " ".join(tight[-n:]))
    f.append(f"last2nl {form} {newline > 0} " + " ".join(tight[-2:]))
    f.append(f"first2 {form} " + " ".join(tight[:2]) + f" {kind_of_end}")
    f.append(f"line {form} " + " ".join(tight[:3]) + f" {_bucket(min(len(tight), 64))} {' '.join(tight[-1:])}")
    f.append(f"lines {form} {_bucket(bare.count(chr(10)))} {kind_of_end}")
    f.append(f"size {form} {_bucket(len(bare))} {kind_of_end}")
    if form in ("code", "conf"):
        opened = {o: bare.count(o) - bare.count(c) for o, c in _CLOSERS.items()}
        for o, n in opened.items():
            f.append(f"open {style} {o} {_bucket(max(0, n))}")
        f.append(f"any open {form} {any(n > 0 for n in opened.values())} {newline > 0}")
        f.append(f"quotes {style} {last_line.count(chr(34)) % 2} {last_line.count(chr(39)) % 2} {bare.count(chr(34) * 3) % 2} {bare.count('`') % 2}")
        indent = len(last_line) - len(last_line.lstrip())
        f.append(f"indent {style} {_bucket(indent)} {' '.join(tight[:1])} {newline > 0}")
        f.append(f"style {style}")
    else:
        f.append(f"fence {bare.count('```') % 2} {kind_of_end}")
        f.append(f"tick {last_line.count('`') % 2}")
        f.append(f"paren {last_line.count('(') > last_line.count(')')}")
        f.append(f"kind {kind}")
    closed = kind_of_end in ".?!。`}" or kind_of_end == "none"
    f.append(f"limit {at_limit(text, limits)} {closed}")
    word, known, part = None, [], []
    if kind_of_end == "letter":
        word = "".join(subwords(last_line)[-1:])
        known, part = ([f"word {x}", f"word {form} {x} {newline > 0}", f"word {form} {x} {' '.join(tight[:1])} {_bucket(min(len(tight), 64))} {shapes[-1] == 'I'}"] for x in (True, False))
    if n_chars is not None and n_chars > len(text.encode("utf-8", "replace")):
        f.append("reported longer")
    if end == "�":
        f.append("broken character")
    f.append("always")
    return word, _hashed(f), _hashed(known), _hashed(part)


def common_words(texts: DataFrame, least_texts: int = 2) -> DataFrame:
    """(word, known): the words, without regard to case, of at least least_texts rows (text), their last words left out, which may be parts of words."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = Counter(w for text in batch["text"] for w in set(subwords(text)[:-1]))
            yield pd.DataFrame(list(seen.items()), columns=["word", "n"], dtype=object)

    counts = texts.select("text").mapInPandas(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least_texts).select("word", F.lit(True).alias("known"))


def cut_once(text: str, rng: np.random.Generator, limits: Collection[int]) -> str | None:
    """text cut inside a word, sentence or line; null where it is too short for that."""
    if len(text) < 60:
        return None
    within = [m for m in limits if 60 < m < len(text)]
    for _ in range(6):
        at = int(within[rng.integers(len(within))]) if within and rng.random() < 0.4 else int(rng.integers(max(30, len(text) // 5), len(text) - 2))
        head = text[:at]
        rest = text[at:].strip()
        if rest and head[-1:] not in ".?!。？！\n;}" and not head.rstrip().endswith((".", "?", "!", "。", ";", "}")) and len(rest) > 3:
            return head
        within = []
    return None


def _fit(rows: list[np.ndarray], y: np.ndarray, decay: float, steps: int, start: np.ndarray | None = None, still: float = 0.02) -> np.ndarray:
    """Weights of a logistic regression by full gradients with adaptive steps; the same rows give the same weights.

    It ends when the mean loss of fifty steps falls by less than the part `still` of it, or after `steps`.
    """
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, m, v = np.zeros(DIMENSIONS) if start is None else start.copy(), np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    before = np.inf
    for t in range(1, steps + 1):
        z = np.clip(np.bincount(owner, w[flat], len(rows)), -30, 30)
        e = 1 / (1 + np.exp(-z)) - y
        g = np.bincount(flat, e[owner], DIMENSIONS) / len(rows) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        if t % 50 == 0:
            loss = np.mean(np.logaddexp(0, z) - y * z) + decay / 2 * (w @ w)
            if before - loss < still * before:
                break
            before = loss
    return w


def _odd(x: list[np.ndarray], y: np.ndarray, fold: np.ndarray, decay: float, steps: int, rounds: int = 4) -> np.ndarray:
    """Which texts given as intact look cut to a regression that has not seen them: one fitted on the other half.

    Each round leaves out what the one before found, and its regressions begin where that one's ended.
    """
    odd = np.zeros(len(x), bool)
    fitted: dict[int, np.ndarray] = {}
    for _ in range(rounds):
        judged = odd.copy()
        for k in (0, 1):
            seen = (fold != k) & ~odd
            if len(set(y[seen])) < 2:
                continue
            fitted[k] = w = _fit([f for f, s in zip(x, seen, strict=True) if s], y[seen], decay, steps, fitted.get(k))
            here = (fold == k) & (y == 0)
            judged[here] = [w[x[i]].sum() > ODD for i in np.flatnonzero(here)]
        if (judged == odd).all():
            break
        odd = judged
    return odd


def source_limits(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", least_share: float = 0.02, least_rows: int = 8) -> DataFrame:
    """(source, limits): lengths, in characters or bytes, at which unusually many different texts of a source end, from all rows.

    A length counts with at least least_rows texts, least_share of its source's, and four times as many as the lengths
    around it hold on average; so a source has at most 2 / least_share of them. Sources with fewer texts than
    least_rows of one length have none that could be told from chance.
    """
    t = F.col(text_col)
    texts = docs.filter(t.isNotNull() & (F.length(t) >= 100)).select(F.coalesce(same_spelling(F.col(source_col)), F.lit("")).alias("source"), F.xxhash64(t).alias("h"), F.array(F.length(t), F.octet_length(t)).alias("m")).dropDuplicates(["source", "h"])
    # all further counts are made from those per length, which are few
    lengths = cut(texts.select("source", F.posexplode("m").alias("unit", "size"), (F.get("m", F.lit(0)) == F.get("m", F.lit(1))).alias("same")).filter("unit = 0 or not same").groupBy("source", "size", "unit").agg(F.count(F.lit(1)).alias("n")))
    sizes = lengths.groupBy("source", "size").agg(F.sum("n").alias("n"))
    around = sizes.groupBy("source", F.floor(F.col("size") / 200).alias("part")).agg(F.sum("n").alias("near"))
    of_source = lengths.filter("unit = 0").groupBy("source").agg(F.sum("n").alias("all"))
    spikes = sizes.filter(F.col("n") >= least_rows).withColumn("part", F.floor(F.col("size") / 200)).join(around, ["source", "part"]).join(of_source, "source")
    spikes = spikes.filter((F.col("n") >= least_share * F.col("all")) & (F.col("n") * 200 >= 4 * F.col("near")))
    return spikes.groupBy("source").agg(F.array_sort(F.collect_list("size")).alias("limits"))


def cut_off(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", kind_col: str = "kind", path_col: str = "path", reported_col: str = "n_chars", sample_rows: int = 8000, least_texts: int = 2, threshold: float = 0.6, decay: float = 1e-5, steps: int = 500) -> DataFrame:
    """(id, source, score, cut): how likely each text was cut off before its end, and whether it is at least threshold.

    About sample_rows texts, drawn by a hash of their ids, train the regression: each as it is, and each cut
    inside a word, sentence or line, at a length at which its source cuts or anywhere, some with a mark put after the
    cut or with the length reported before it. Texts that carry such a mark, are reported longer than they are, or are as
    long as their source allows without closing are no examples; texts that a regression fitted on the other half of the
    examples takes for cut are left out as intact ones. Words of at least least_texts texts tell whether a last word is whole. They and the lengths at which sources cut are counted over all rows, and all rows are scored, whole.

    Null and blank texts are not cut (score 0). Null sources, kinds, paths and reported lengths are values like others. Null ids
    are left out, repeated rows repeat their result. An empty table gives no rows.
    """
    limits = cut(source_limits(docs, source_col=source_col, text_col=text_col))
    ending = F.coalesce(F.lower(F.regexp_extract(F.col(path_col), r"(\.[A-Za-z]{1,5})$", 1)), F.lit(""))
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(same_spelling(F.col(source_col)), F.lit("")).alias("source"), F.coalesce(F.col(kind_col), F.lit("")).alias("kind"), ending.alias("ending"), F.col(reported_col).cast("long").alias("reported"))
    rows = lookup_join(rows, limits, ["source"], "left", weights=rows.select("source")).select(*rows.columns, F.coalesce("limits", F.array().cast("array<int>")).alias("limits"))

    readable = rows.filter(F.trim("text") != "")
    total = docs.count()
    share = min(1.0, sample_rows / max(1, total))
    drawn = readable.withColumn("h", F.xxhash64(F.lit(10), "id", "text")).filter(F.pmod(F.col("h"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)

    common = cut(common_words(readable, least_texts))
    any_known = not common.isEmpty()

    def either(text: str, *rest) -> tuple[str | None, list[int], list[int] | None]:
        """The last word, the features if it is whole, and those if it is not."""
        word, f, known, part = closing(text, *rest)
        return (word, sorted(f | known), sorted(f | part)) if any_known and word is not None else (None, sorted(f), None)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for _, text, _, kind, end, reported, known, h in batch.itertuples(index=False, name=None):
                rng = np.random.default_rng(abs(int(h)))
                n = None if reported is None or reported != reported else int(reported)
                if surely_odd(text, n, known):
                    continue
                out.append((int(h), 0, *either(text, kind, end, n, known)))
                head = cut_once(text, rng, known)
                if head is not None:
                    said = len(text) if rng.random() < 0.1 else len(head)
                    if rng.random() < 0.15:
                        head += MARKS[int(rng.integers(len(MARKS)))]
                    out.append((int(h), 1, *either(head, kind, end, said, known)))
            yield pd.DataFrame(out, columns=["h", "y", "word", "f", "f_part"], dtype=object)

    examples = lookup_join(cut(drawn.mapInPandas(featured, "h long, y int, word string, f array<int>, f_part array<int>")), common, ["word"], "left")
    whole = F.col("word").isNull() | F.col("known").isNotNull()
    sample = examples.select("h", "y", F.when(whole, F.col("f")).otherwise(F.col("f_part")).alias("f")).toPandas().sort_values(["h", "y"])
    if len(sample) and sample["y"].nunique() == 2:
        x, y = [np.asarray(f, dtype=np.int64) for f in sample["f"]], sample["y"].to_numpy(float)
        odd = _odd(x, y, sample["h"].to_numpy() % 2, decay, steps)
        w = _fit([f for f, o in zip(x, odd, strict=True) if not o], y[~odd], decay, steps)
    else:
        w = np.zeros(DIMENSIONS)
        w[zlib.crc32(b"always") % DIMENSIONS] = -30.0
    weights = w.astype(np.float32)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text, source, kind, end, reported, known in batch.itertuples(index=False, name=None):
                word, z, z_part = None, None, None
                if text is not None and text.strip():
                    n = None if reported is None or reported != reported else int(reported)
                    word, *f = either(text, kind, end, n, known)
                    z, z_part = (None if x is None else float(weights[x].sum()) for x in f)
                out.append((i, source, word, z, z_part))
            yield pd.DataFrame(out, columns=[id_col, "source", "word", "z", "z_part"], dtype=object)

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("source", T.StringType()), T.StructField("word", T.StringType()), T.StructField("z", T.DoubleType()), T.StructField("z_part", T.DoubleType())])
    met = lookup_join(cut(rows.mapInPandas(scored, schema)), common, ["word"], "left")  # cut: a large lookup is joined in parts, and texts are to be read once
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.when(whole, F.col("z")).otherwise(F.col("z_part"))))
    score = F.when(F.col("z").isNull(), 0.0).otherwise(1 / (1 + F.exp(-z)))
    return met.select(id_col, "source", score.alias("score"), (score >= threshold).alias("cut"))


def cut_rates(scored: DataFrame) -> DataFrame:
    """(source, texts, cut, rate) of every source."""
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("cut")).withColumn("rate", F.col("cut") / F.col("texts"))
