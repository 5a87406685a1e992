"""Language identification by rank-order n-gram profiles.

A profile is the PROFILE most frequent n-grams of a language, of one to three letters within words that are padded by a
boundary on both sides. A document's own TOP most frequent n-grams are compared to each profile by the out-of-place
measure: the sum over them of how far each one's rank is from its rank there, PROFILE if it is not there at all. The
nearest language is predicted. Counts cover the whole text of every document to learn from, and predictions whole texts.

Letters are what Unicode calls letters, lower-cased; everything else is a boundary.

score is 1 minus the distance over the largest possible distance. A text that is null or has no letter gets `und` and 0,
as does every text if nothing was learned. Ties of n-grams go to the smaller code, of languages to the smaller name.

Nulls and odd cases: rows with a null text or lang teach nothing; a null doc_id counts as the empty string in the fold;
repeated rows count as often as they come; an empty table gives no rows; other columns are not looked at. The model that
goes to the executors is at most LANGUAGES * PROFILE n-grams; more languages are an error, not a silent cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROFILE, TOP, LANGUAGES = 400, 300, 2000
#: Least score of a text in a learned language. Of 1,653 held-out documents of sf0.1 the lowest score is 0.47; with a language left out
#: of those to learn, its documents score 0.36 or less (English and Spanish 0.38 and 0.37) in 95 of 100 cases.
LEAST = 0.4
EDGE = np.uint64(0x5F)
_letters: dict = {}


def _letter() -> np.ndarray:
    if "t" not in _letters:
        _letters["t"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters["t"]


def symbols(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single boundaries of all texts, a boundary before and after each; and where each text starts."""
    low = ["_" + t.lower() + "_" if t else "_" for t in texts]
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    first = np.cumsum([0, *map(len, low)])
    s = np.where(_letter()[cp], cp, np.uint32(EDGE)).astype(np.uint64)
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != EDGE) | (s[:-1] != EDGE)
    keep[first[:-1]] = True  # a text keeps its own boundary
    return s[keep], np.concatenate(([0], np.cumsum(keep)))[first]


def grams(s: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of one to three symbols without a boundary inside: 21 bits a symbol."""
    edge = s == EDGE
    one = s[~edge]
    two = (s[:-1] | s[1:] << np.uint64(21))[~(edge[:-1] & edge[1:])]
    three = (s[:-2] | s[1:-1] << np.uint64(21) | s[2:] << np.uint64(42))[~edge[1:-1]]
    return np.concatenate((one, two, three)) if len(one) else np.zeros(0, np.uint64)


def _counter(batches):
    """(lang, gram, n) of a partition; tables are merged as they grow."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(lang, parts, weights):
        codes, inv = np.unique(np.concatenate(parts), return_inverse=True)
        return codes, np.bincount(inv, weights=np.concatenate(weights), minlength=len(codes)).astype(np.int64)

    for b in batches:
        by: dict[str, list] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < 1 << 20):
                    size += len(texts[j])
                    j += 1
                codes, n = np.unique(grams(symbols(texts[i:j])[0]), return_counts=True)
                old = held.get(lang)
                held[lang] = add(lang, [old[0], codes], [old[1], n]) if old else (codes, n)
                i = j
    for lang, (codes, n) in held.items():
        for lo in range(0, len(codes), 65536):
            part = slice(lo, lo + 65536)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes[part]), pa.string()), pa.array(codes[part].view(np.int64)), pa.array(n[part])], ["lang", "gram", "n"])


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the sorted n-grams of all profiles, and their ranks: (n-grams, languages), PROFILE where absent."""
    src = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = src.mapInArrow(_counter, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank - 1).where(f"rank < {PROFILE}")
    rows = top.select("lang", "gram", "rank").limit(LANGUAGES * PROFILE + 1).collect()
    if len(rows) > LANGUAGES * PROFILE:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    langs = sorted({r.lang for r in rows})
    codes = np.unique(np.array([r.gram for r in rows], dtype=np.int64).view(np.uint64))
    ranks = np.full((len(codes), len(langs)), PROFILE, dtype=np.int32)
    if rows:
        ranks[np.searchsorted(codes, np.array([r.gram for r in rows], dtype=np.int64).view(np.uint64)), [langs.index(r.lang) for r in rows]] = [r.rank for r in rows]
    return langs, codes, ranks


def distances(s: np.ndarray, codes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, int] | None:
    """Out-of-place distance to each language and the number of n-grams compared; None without a letter."""
    own, n = np.unique(grams(s), return_counts=True)
    if not len(own):
        return None
    order = np.argsort(-n, kind="stable")[:TOP]
    own = own[order]
    at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
    there = ranks[at]
    there[codes[at] != own] = PROFILE
    gap = np.abs(there - np.arange(len(own))[:, None])
    gap[there == PROFILE] = PROFILE
    return gap.sum(axis=0), len(own)


def _predictor(langs: list[str], codes: np.ndarray, ranks: np.ndarray):
    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            i = 0
            while i < len(texts) and langs:
                j, size = i, 0
                while j < len(texts) and (j == i or size < 1 << 18):
                    size += len(texts[j] or "")
                    j += 1
                s, first = symbols(texts[i:j])
                for k in range(i, j):
                    if texts[k] and (found := distances(s[first[k - i] : first[k - i + 1]], codes, ranks)):
                        best = int(found[0].argmin())
                        pred[k], score[k] = langs[best], 1 - float(found[0][best]) / (PROFILE * found[1])
                i = j
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*b.schema.names[1:], "lang_pred", "score"])

    return run


def fold(id_col: str, mod: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def identify(docs: DataFrame, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; documents of the held-out fold teach nothing."""
    out = fold(id_col, folds) == held
    model = learn(docs.where(~out), text_col, lang_col)
    src = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"))
    return src.mapInArrow(_predictor(*model), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows whose language can't be told. All labelled rows teach.

    These are `und`, a score of 0, which is a text without a known n-gram, and a score under least. The last takes a full profile of the language
    predicted: one of fewer than PROFILE n-grams has been taught too little to say what its language lacks.
    """
    langs, codes, ranks = learn(docs, text_col, lang_col)
    bound = {x: least if n == PROFILE else 0.0 for x, n in zip(langs, (ranks < PROFILE).sum(axis=0).tolist(), strict=True)}
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            pred = next(_predictor(langs, codes, ranks)([pa.RecordBatch.from_arrays([b.column(at)], ["text"])]))
            ok = [p != "und" and s > 0 and s >= bound[p] for p, s in zip(pred.column(0).to_pylist(), pred.column(1).to_pylist(), strict=True)]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
