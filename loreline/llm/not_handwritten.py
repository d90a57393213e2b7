"""Source and configuration files that nobody in the project wrote by hand.

A random forest looks at what a file is made of: how well it compresses, the entropy of its tokens, its identifiers, its
comments, how alike its lines are. Header notices and file names that say what a file is label the examples, and are
hidden from the features; they decide nothing by themselves. Copies of a third party's files do not differ in these
features, for somebody wrote them by hand; only what says where they come from, the notice or the folder, tells them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreline.session import cut

_COMMENT = re.compile(r"\s*(?:#(?!\[)|//|/\*|\*|<!--|--|;|\"\"\"|''')")
_REMARK = re.compile(r"^\s*(?:#(?!\[)|//|/\*|\*|<!--)|\s(?:#|//) \w")
# What notices say. The first two label examples, the last tells where a copy comes from.
_HAND = re.compile(r"(?i)(?:maintained|written|edited|kept|tuned) by hand|hand[- ](?:written|maintained)|not (?:a build output|generated)")
_TOOL = re.compile(r"(?i)\b(?:code )?(?:auto-?)?generated (?:by|from|with)\b|@generated\b|\bautogenerated\b|\bauto-generated\b|\bautomatically (?:generated|created|produced)|created automatically|automatisch erzeugt|\bproduced by \S+ .*from|généré automatiquement|generado automáticamente|do not (?:edit|modify)\b|manual changes will be lost|^\W*source: \S+\.proto")
# Without any of these in its lower-cased text a file holds nothing that _TOOL finds, nor the other marks of a tool.
_TELLING = ["generat", "automat", "génér", "produced by", "do not ", "manual changes", "source:", "sourcemappingurl", "lockfileversion"]
_BANNER = re.compile(r"/\*! ?[\w./@-]+ v?\d+(?:\.\d+)+ ?\|")
_OWNED = re.compile(r"(?i)SPDX-License-Identifier|copyright .*contributors")
_PROVENANCE = re.compile(r"(?i)\b(?:vendored|verbatim|unmodified|unchanged)\b.*\b(?:copy|from|of|version)\b|\b(?:imported|copied|included|taken) (?:as[- ]is|verbatim|unchanged|from (?:https?:|git:|upstream))|\bthird[- ]party (?:code|copy|file|library|source)|(?:\(c\)|©) ?\d{4}(?:-\d{4})? the \S+ (?:authors|developers|team)|\bupstream (?:copy|version|source)\b|^\W*[a-z][\w.-]+ v?\d+\.\d+\.\d+\W*$")
# Names and folders that say what a file is.
_TOOL_NAME = re.compile(r"(?i)\.min\.(?:js|css|mjs)$|\.bundle\.js$|\.map$|\.pb\.(?:go|cc|h)$|_pb2(?:_grpc)?\.pyi?$|\.(?:generated|gen|g)\.\w+$|(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|npm-shrinkwrap\.json|go\.sum|[\w-]+\.lock)$")
_THIRD_FOLDER = re.compile(r"(?i)(?:^|/)(?:vendor|third_party|third-party|external|extern|deps|node_modules|bower_components)/[^/]+/")
_IDENT = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_TOKEN = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*|\d[\w.]*|[^\w\s]")
_LITERAL = re.compile(r"\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|\b0x[0-9a-fA-F]+\b|\b\d[\d._eE]*\b|[\s,;:\[\]{}()-]+", re.S)
_PART, _STATEMENT = re.compile(r"[\n;{}]"), re.compile(r"[;{}]")
_NUMBER = re.compile(r"\d[\w.]*")
_RUN = re.compile(r"[A-Za-z0-9+/=_-]{64,}")

FEATURES = ["compression", "entropy", "distinct_tokens", "ident_length", "short_idents", "ident_share", "comments", "line_length", "longest_line", "log_size", "digits", "blanks", "punctuation", "runs", "literals", "alike", "most_alike", "templates", "config"]


def notices(lines: list[str]) -> tuple[list[str], int]:
    """The comment lines before the first line of code, all of them, and how many lines come before the first that is neither comment nor blank."""
    said: list[str] = []
    top, block, code = 0, False, False
    for i, x in enumerate(lines):
        bare = x.strip()
        if block or _COMMENT.match(x):
            said.append(x)
            opened = bare.rfind("/*")
            block = bare.rfind("*/") <= opened if opened >= 0 else block and "*/" not in bare
            top = top if code else i + 1
        elif not bare:
            top = top if code else i + 1
        elif bare.startswith(("package ", "import ", "using ", "use ", "from ", "#")):
            code = True
            if x.startswith("#"):
                said.append(x)
        else:
            break
    return said, top


def says(text: str, path: str | None) -> str:
    """'tool', 'third' or 'hand' by the notice at the top or the file's name; 'owned' if the project claims it; '' if nothing is said."""
    noted = notices(text.split("\n"))[0]
    if any(_HAND.search(x) for x in noted):
        return "hand"
    if any(_PROVENANCE.search(x.rstrip("\r")) for x in noted) or (path and _THIRD_FOLDER.search(path.strip().replace("\\", "/"))):
        return "third"
    last = text.rstrip().rsplit("\n", 1)[-1]
    if any(_TOOL.search(x) or _BANNER.search(x) for x in noted) or (path and _TOOL_NAME.search(path.strip())) or ("Generated" in text and re.search(r"(?m)^\s*@(?:\w+\.)*Generated\b", text)) or "//# sourceMappingURL=" in last or '"lockfileVersion"' in text:
        return "tool"
    return "owned" if any(_OWNED.search(x) for x in noted) else ""


def features(text: str, config: bool) -> list[float]:
    """What a file is made of, without the comments at its top and without notices anywhere."""
    lines = text.replace("\r\n", "\n").split("\n")
    top = notices(lines)[1]
    low = text.lower()
    body = lines[top:] if not any(w in low for w in _TELLING) else [x for x in lines[top:] if not (len(x) < 200 and (_TOOL.search(x) or "sourceMappingURL" in x or "lockfileVersion" in x or "Generated(" in x))]
    kept = "\n".join(body)
    n = max(1, len(kept))
    raw = kept.encode("utf-8", "replace")
    tokens = Counter(_TOKEN.findall(kept))
    total = sum(tokens.values()) or 1
    entropy = -sum(c / total * math.log2(c / total) for c in tokens.values())
    idents = [(t, c) for t, c in tokens.items() if _IDENT.fullmatch(t)]
    names = sum(c for _, c in idents) or 1
    full = [x for x in body if x.strip()]
    some = max(1, len(full))
    wrapped = n / some > 120  # then line ends say nothing, statements do
    parts = [x.strip() for x in (_STATEMENT.split(kept.replace("\n", "")) if wrapped else _PART.split(kept)) if x.strip()]
    # every part's names and numbers are replaced at once; a part holds no line end
    templates = Counter(_NUMBER.sub("0", _IDENT.sub("a", "\n".join(parts))).split("\n")) if parts else Counter()
    many = max(1, len(parts))
    twice = sum(c for c in templates.values() if c > 1)
    literal = sum(len(m) for m in _LITERAL.findall(kept))
    digits = sum(len(t) * c for t, c in tokens.items() if t[0].isdigit())
    return [
        len(zlib.compress(raw, 6)) / max(1, len(raw)),
        entropy,
        len(tokens) / total,
        sum(len(t) * c for t, c in idents) / names,
        sum(c for t, c in idents if len(t) <= 2) / names,
        sum(len(t) * c for t, c in idents) / n,
        sum(1 for x in full if _REMARK.search(x)) / some,
        min(n / some, 150.0),  # longer lines say no more: minified files are wrapped at any width
        min(max(map(len, body), default=0), 300.0),
        math.log1p(n),
        digits / n,
        (n - sum(len(t) * c for t, c in tokens.items())) / n,
        sum(c for t, c in tokens.items() if not t[0].isalnum() and t[0] not in "_$") / n,
        sum(len(m) for m in _RUN.findall(kept)) / n,
        literal / n,
        twice / many,
        (templates.most_common(1)[0][1] if templates else 0) / many,
        len(templates) / many,
        float(config),
    ]


def is_data(f: list[float], config: bool) -> bool:
    """Whether a code file is nothing but literals or one line again and again: by itself a label, for such files carry no notice."""
    x = dict(zip(FEATURES, f, strict=True))
    return not config and x["comments"] < 0.02 and x["log_size"] > 6 and (x["literals"] > 0.93 or x["most_alike"] > 0.75)


def fitted(forest: RandomForestClassifier, rows: DataFrame) -> RandomForestClassificationModel:
    """The fitted forest without its training summary: that holds the session, which cannot be sent to executors once a query has been observed in it."""
    return forest.fit(rows).copy()


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", kind_col: str = "kind", kinds: tuple[str, ...] = ("source_file", "config_file"), config_kind: str = "config_file", sample_rows: int = 12_000, trees: int = 30, depth: int = 9, threshold: float = 0.5, seed: int = 5) -> DataFrame:
    """(id, said, score, foreign): what a file says of itself, the forest's score, and whether it is not hand-written here.

    Files that say a tool made them, and code that is all literals or one line again and again, are the forest's positive examples, files that say the
    opposite or that the project owns them its negative ones; so are those that say nothing, less those that a first forest finds
    more like the positive ones. At most about sample_rows files, drawn by a hash, are examples; features and scores
    cover all files and whole texts. foreign: a score of at least threshold, or said to be a third party's.

    Null and blank texts and other kinds give no rows; null paths say nothing. Null ids are left out, repeated rows
    repeat their result. Without positive or negative examples what files say is their score. An empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text, path, config in batch.itertuples(index=False, name=None):
                said, f = says(text, path), features(text, config)
                out.append((i, said, "data" if not said and is_data(f, config) else said, zlib.crc32(text.encode("utf-8", "replace")), *f))
            yield pd.DataFrame(out, columns=[id_col, "said", "label", "h", *FEATURES], dtype=object)

    id_field = T.StructField(id_col, docs.schema[id_col].dataType)
    schema = T.StructType([id_field, T.StructField("said", T.StringType()), T.StructField("label", T.StringType()), T.StructField("h", T.LongType()), *[T.StructField(f, T.DoubleType()) for f in FEATURES]])
    rows = docs.filter(F.col(kind_col).isin(*kinds) & F.col(id_col).isNotNull() & (F.trim(text_col) != "")).select(id_col, text_col, path_col, (F.col(kind_col) == config_kind).alias("config"))
    seen = cut(rows.mapInPandas(run, schema))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(seen)
    total = seen.filter("label <> 'third'").count()
    share = min(1.0, sample_rows / max(1, total))
    sample = ready.filter((F.col("label") != "third") & (F.pmod(F.xxhash64("h"), F.lit(100_003)) < int(share * 100_003) + 1)).select("label", "features", F.col("label").isin("tool", "data").cast("double").alias("y"))
    sample = cut(sample)
    forest = RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=trees, maxDepth=depth, minInstancesPerNode=3, seed=seed, subsamplingRate=0.8)
    sides = {r["y"] for r in sample.select("y").distinct().collect()}
    if len(sides) < 2:
        scored = seen.withColumn("score", F.col("label").isin("tool", "data").cast("double"))
    else:
        score = vector_to_array("probability")[1]
        first = fitted(forest, sample).transform(sample).withColumn("score", score)
        sure = cut(first.filter((F.col("y") == 1) | F.col("label").isin("hand", "owned") | (F.col("score") < 0.15)).select("features", "y"))
        scored = fitted(forest, sure).transform(ready).withColumn("score", score)
    return scored.select(id_col, "said", "score", ((F.col("said") == "third") | (F.col("score") >= threshold)).alias("foreign"))
