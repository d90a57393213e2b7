"""Token counts: exact ones by an existing tokenizer, and estimates from counts of characters."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreline.operators.joins import lookup_join
from loreline.session import cut

#: A vocabulary file: .tiktoken, .json (tokenizers) or .model (sentencepiece).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's authors split texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[str, Callable[[list[str]], list[int]]] = {}


def counter(path: str = TOKENIZER) -> Callable[[list[str]], list[int]]:
    """A function from texts to numbers of tokens; the vocabulary is read once a process."""
    if path not in _loaded:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _loaded[path] = lambda texts: [len(coder.encode_ordinary(t)) for t in texts]
        elif path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _loaded[path] = lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
    return _loaded[path]


def count_tokens(text: Column, path: str = TOKENIZER) -> Column:
    """Exact number of tokens; null for null."""

    @F.pandas_udf(T.LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path)
        for s in batches:
            known = s.notna()
            out = pd.Series(np.nan, index=s.index, dtype="float64")
            out[known] = count(s[known].tolist())
            yield out.astype("Int64")

    return tokens(text)


def same_spelling(c: Column) -> Column:
    """One spelling for names that differ in case, surrounding blanks or -, _ and blanks; null and empty become null."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s_-]+", "_"), F.lit(""))


# The letters of scripts that tokenizers split in their own ways.
SCRIPTS = {"han": r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}", "kana": r"\x{3040}-\x{30FF}", "hangul": r"\x{AC00}-\x{D7AF}", "cyrillic": r"\x{0400}-\x{052F}", "greek": r"\x{0370}-\x{03FF}", "hebrew_arabic": r"\x{0590}-\x{06FF}", "indic_thai": r"\x{0900}-\x{0E7F}"}


def _letters(script: str):
    pattern = f"[{SCRIPTS[script]}]"
    return lambda t: F.when(F.octet_length(t) == F.length(t), 0).otherwise(F.regexp_count(t, F.lit(pattern)))


#: What the regression sees of a text, besides a constant. Counts of whole texts, made by built-in functions.
FEATURES = {
    "bytes": lambda t: F.octet_length(t),
    "words": lambda t: F.regexp_count(t, F.lit(r"\p{L}+")),
    "digits": lambda t: F.length(t) - F.length(F.translate(t, "0123456789", "")),
    "punctuation": lambda t: F.length(t) - F.length(F.translate(t, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "")),
    "capitals": lambda t: F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
    "blank_runs": lambda t: F.regexp_count(t, F.lit(r"\s{2,}")),
    "humps": lambda t: F.regexp_count(t, F.lit(r"[a-z][A-Z]")),
    "letters_beyond_ascii": lambda t: F.octet_length(t) - F.length(t),
    **{s: _letters(s) for s in SCRIPTS},
}


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Least squares on errors relative to the size of the text, so that no few long texts decide; x starts with a constant and bytes."""
    weight = 1.0 / (x[:, 1] + 50.0)
    a, b = x * weight[:, None], y * weight
    scale = np.maximum(np.abs(a).max(axis=0), 1e-9)
    a = a / scale
    return np.linalg.solve(a.T @ a + ridge * np.eye(x.shape[1]), a.T @ b) / scale


def estimate_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, tokenizer: str = TOKENIZER, sample_rows: int = 600, least_rows: int = 60, shared_rows: int = 12_000) -> DataFrame:
    """(id, language, kept columns, est_tokens) of every row, by a regression per language fitted on tokenized samples.

    About 2 * sample_rows texts of each language, drawn by a hash of their ids, are
    tokenized: one half fits the coefficients, the other half, held out, corrects the bias, the factor being true
    tokens over predicted ones; then the halves change places, and the two models are averaged. Every language is fitted in a task of its
    own, so their number is not bounded. Languages with fewer than least_rows texts in either half
    share one model, fitted on about shared_rows texts of all samples. Counting, predicting and correcting cover all rows.

    Null texts have null tokens, empty ones 0; estimates are not below 0, nor below 1 for a text that is not empty. A null or empty
    lang is 'unknown'. Every row is taken by itself, so repeated ids give repeated rows. An empty table gives no rows.
    """
    lang = F.coalesce(same_spelling(F.col(lang_col)), F.lit("unknown"))
    names = list(FEATURES)
    rows = docs.select(F.col(id_col), lang.alias("language"), *(keep or []), F.col(text_col).alias("_text"))
    plain = docs.select(lang.alias("language"), F.col(text_col).isNotNull().alias("there"))
    sizes = cut(plain.filter("there").groupBy("language").agg((2.0 * sample_rows / F.count(F.lit(1))).alias("_share")))
    if sizes.isEmpty():
        return rows.select(id_col, "language", *(keep or []), F.lit(None).cast("double").alias("est_tokens"))
    draw = (F.pmod(F.xxhash64(F.col(id_col), F.lit(20)), F.lit(1_000_003)) / 1_000_003.0).alias("_draw")
    least = sizes.agg(F.max("_share")).first()[0]  # beyond the greatest share no text is drawn, so most are not joined at all
    tried = rows.select(id_col, "language", "_text", draw).filter((F.col("_draw") < least) & F.col("_text").isNotNull())
    drawn = lookup_join(tried, sizes, ["language"], weights=plain.select("language")).filter(F.col("_draw") < F.col("_share"))
    half = F.pmod(F.xxhash64(F.col(id_col), F.lit(21)), F.lit(2)).alias("half")
    sample = cut(drawn.select("language", half, *[f(F.col("_text")).cast("double").alias(n) for n, f in FEATURES.items()], count_tokens(F.col("_text"), tokenizer).alias("tokens")))

    def half_model(fit: pd.DataFrame, held: pd.DataFrame) -> np.ndarray:
        w = _fit(np.column_stack([np.ones(len(fit)), fit[names].to_numpy()]), fit["tokens"].to_numpy(float))
        predicted = np.maximum(np.column_stack([np.ones(len(held)), held[names].to_numpy()]) @ w, 0).sum()
        return w * (held["tokens"].sum() / predicted if predicted > 0 else 1.0)

    def model(part: pd.DataFrame) -> list[float]:
        part = part.sort_values(["language", "half", *names, "tokens"])
        a, b = part[part["half"] == 0], part[part["half"] == 1]
        a, b = (a, b) if len(a) and len(b) else (part, part)
        return [float(c) for c in (half_model(a, b) + half_model(b, a)) / 2]

    def of_language(part: pd.DataFrame) -> pd.DataFrame:
        enough = min((part["half"] == 0).sum(), (part["half"] == 1).sum()) >= least_rows
        return pd.DataFrame([(part["language"].iloc[0], model(part))] if enough else [], columns=["language", "_w"], dtype=object)

    n = max(1, sample.count())
    few = sample.filter(F.pmod(F.xxhash64(*names, "language"), F.lit(1_000_003)) < int(min(1.0, shared_rows / n) * 1_000_003) + 1).toPandas()
    every = model(few if len(few) else sample.limit(shared_rows).toPandas())
    models = cut(sample.groupBy("language").applyInPandas(of_language, "language string, _w array<double>"))  # a language's sample is about 2 * sample_rows rows
    w = F.coalesce("_w", F.array(*[F.lit(c) for c in every]))
    total = F.get(w, F.lit(0))
    for i, name in enumerate(names, 1):
        total = total + F.get(w, F.lit(i)) * F.col(name)
    counted = rows.select(id_col, "language", *(keep or []), *[f(F.col("_text")).cast("double").alias(name) for name, f in FEATURES.items()])
    met = lookup_join(counted, models, ["language"], "left", weights=plain.select("language"))
    return met.select(id_col, "language", *(keep or []), F.when(F.col("bytes") == 0, 0.0).when(F.col("bytes") > 0, F.greatest(total, F.lit(1.0))).alias("est_tokens"))


def sized(docs: DataFrame, id_col: str, text_col: str, keep: list[str], tokenizer: str) -> DataFrame:
    """(id, kept columns, tokens) with exact token counts of all rows that have a text, kept in the shared folder."""
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return cut(rows.select(id_col, *keep, count_tokens(F.col(text_col), tokenizer).alias("tokens")))
