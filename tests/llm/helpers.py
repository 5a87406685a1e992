"""Small fixtures and brute-force versions."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, rep long, row long, sig string, label string, v string, block int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts: dict, langs: dict | None = None, parts: int = 3):
    """Documents, with columns whose names clash with those that operators use inside."""
    rows = [(i, t, (langs or {}).get(i, "en"), "s", len(t or ""), "k", 7, 7, "x", "y", "z", 1) for i, t in texts.items()] if isinstance(texts, dict) else [(i, t, "en", "s", 0, "k", 7, 7, "x", "y", "z", 1) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def lower(t: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def shingles(text, k: int) -> set:
    w = WORD.findall(lower(text or ""))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def closed(ids, links) -> dict:
    low = {i: i for i in ids}
    while True:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
        if not changed:
            return low


def near_texts(seed: int = 1) -> dict:
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 6))) for _ in range(400)]
    texts: dict = {}
    for i in range(60):
        texts[i] = " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 20, 60, 200])))
    for i in range(60, 160):
        w = texts[rnd.randrange(60)].split()
        for _ in range(rnd.randrange(0, max(1, len(w) // 12) + 1)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        texts[i] = " ".join(w).upper() if i % 7 == 0 else "\t".join(w)
    base = [rnd.choice(vocabulary) for _ in range(50)]
    for i in range(200, 240):  # a chain: neighbours are alike, its ends are not
        base = list(base)
        base[i - 200] = f"w{i}"
        texts[i] = " ".join(base)
    texts |= {300: None, 301: "", 302: " \n\t ", 303: "one", 304: "ONE", 305: "é one", 306: "x " * 30000, 307: "x x"}
    return texts
