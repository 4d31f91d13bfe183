"""License scans: winnowed fingerprints find candidates, banded alignment measures them.

Templates are winnowed (k-grams of words, rightmost smallest of each window)
into an inverted index; a template of fewer words than the guarantee is
indexed by all its words at once. Documents are winnowed alike. A document's
hits on one template are gathered into regions by place and diagonal, and each
region is aligned with the template word by word within a band around its
diagonals. Where words were inserted or left out, a copy falls into several
regions: those that follow each other in the document and in the template, with
no more than the template's length between them, form a chain, which is aligned
as one along the bands of all its regions. Reported are the share of the
template's words that the best region or chain matches, and the spans of all
that reach `min_coverage`.

Templates are whole license texts and standard notices (`license_texts`), and
the lines by which texts refer to licenses, made of phrases and names by rule.
Others may be given. The index is built from them only and is broadcast in
blocks of a bounded size, each a pass of its own. Documents are read where they
lie, whole. Null and empty texts have no matches; repeated rows are reported
each; an empty table has none; other columns are not looked at.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import Memo, append_columns, table, words_of
from shelfmark.llm.decontam import WORDS
from shelfmark.llm.winnow import Filter, code, kgrams, select

#: Whole texts and standard notices, a file each; its name is the license's.
TEXTS = Path(__file__).parent / "license_texts"
#: How a text refers to its license in a line: any of the phrases before any of the names.
PHRASES = [f"{verb} under {article}".strip() for verb in ("licensed", "released", "distributed", "available", "published") for article in ("the", "a", "")]
NAMES = {
    "MIT": ["MIT License"], "ISC": ["ISC License"], "Zlib": ["zlib License"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"], "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
} | {
    f"{short}-{version}": [f"GNU {kind} Public License, version {version}", f"GNU {kind} Public License v{version}", f"{short} v{version}", f"{short}-{version}"]
    for short, kind, versions in (("GPL", "General", ("2", "3")), ("LGPL", "Lesser General", ("2.1", "3")), ("AGPL", "Affero General", ("3",))) for version in versions
} | {
    f"CC-{'-'.join(x[0] for x in parts)}-4.0": [f"CC {'-'.join(x[0] for x in parts)} 4.0", f"Creative Commons {'-'.join(x[1] for x in parts)} 4.0 International License"]
    for parts in ([("BY", "Attribution"), *more] for more in ([], [("SA", "ShareAlike")], [("ND", "NoDerivatives")], [("NC", "NonCommercial")], [("NC", "NonCommercial"), ("SA", "ShareAlike")], [("NC", "NonCommercial"), ("ND", "NoDerivatives")]))
}


def templates() -> dict[str, list[str]]:
    """Texts and notices by name, and as `<license>-reference` the lines that refer to one. A name may have several wordings."""
    texts = {f.stem: [f.read_text()] for f in sorted(TEXTS.glob("*.txt"))}
    lines = {f"{name}-reference": [f"{phrase} {x}" for x in names for phrase in PHRASES] for name, names in NAMES.items()}
    return texts | lines | {"All-rights-reserved": ["All rights reserved."]}


MATCH = T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("matched_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])))])


def build(templates: dict[tuple[str, int], str], k: int, w: int) -> dict:
    """The words of each template (a name and the number of its wording), and by guarantee length: k, window, and the (template, place) of each fingerprint."""
    words = {key: own for key, text in templates.items() if (own := words_of(text, WORDS))}
    groups: dict[int, dict] = {}
    for key, own in words.items():
        length = min(k + w - 1, len(own))
        size = min(k, length) if length == k + w - 1 else length
        group = groups.setdefault(length, {"k": size, "w": length - size + 1, "postings": {}})
        h = kgrams(np.array([code(x) for x in own], np.uint64), size)
        for p in select(h, group["w"]).tolist():
            group["postings"].setdefault(int(h[p]), []).append((key, p))
    return {"words": words, "groups": groups}


def align(template: list, region: list, low: int, high: int) -> tuple[int, int, int]:
    """The most words of the template that the region holds in order, on diagonals (region place minus template place) low to high; first and last region place used.

    Cells are template words by diagonals: longest common subsequence within the band. Of equal ones the shortest stretch of the region counts.
    """
    width = high - low + 1
    none = (0, 0, 0)  # matched, minus the stretch's length, its end
    row = [none] * width
    starts = [0] * width
    for i, word in enumerate(template):
        now, begin = [none] * width, [0] * width
        for d in range(width):
            j = i + low + d
            best, at = (row[d + 1], starts[d + 1]) if d + 1 < width else (none, 0)  # the template's word is missing
            if d and now[d - 1] > best:  # the region's word is extra
                best, at = now[d - 1], begin[d - 1]
            if 0 <= j < len(region) and region[j] == word:
                matched, _, _ = row[d]
                first = starts[d] if matched else j
                if (found := (matched + 1, first - j, j)) > best:
                    best, at = found, first
            now[d], begin[d] = best, at
        row, starts = now, begin
    d = max(range(width), key=lambda x: row[x])
    return row[d][0], starts[d], row[d][2]


def align_bands(template: list, region: list, diagonals: list[int]) -> tuple[int, int, int]:
    """Like align(), on the given diagonals only, which ascend and may leave gaps. Across a gap the words between are skipped."""
    none = (0, 0, 0)
    width = len(diagonals)
    rows = [([none] * width, [0] * width)]  # by template words read
    for i, word in enumerate(template):
        row, starts = rows[-1]
        now, begin = [none] * width, [0] * width
        for d, diagonal in enumerate(diagonals):
            best, at = none, 0
            if d + 1 < width and (up := i + 1 - (diagonals[d + 1] - diagonal)) >= 0:  # the template's words are missing
                best, at = rows[up][0][d + 1], rows[up][1][d + 1]
            if d and now[d - 1] > best:  # the region's words are extra
                best, at = now[d - 1], begin[d - 1]
            j = i + diagonal
            if 0 <= j < len(region) and region[j] == word:
                matched, _, _ = row[d]
                first = starts[d] if matched else j
                if (found := (matched + 1, first - j, j)) > best:
                    best, at = found, first
            now[d], begin[d] = best, at
        rows.append((now, begin))
    row, starts = rows[-1]
    d = max(range(width), key=lambda x: row[x])
    return row[d][0], starts[d], row[d][2]


def chains(regions: list[dict], most: int) -> list[list[int]]:
    """Regions in order of place that continue each other in the template, at most `most` words apart; those of most hits first, each region in one chain."""
    out, free = [], set(range(len(regions)))
    while free:
        total, before = {}, {}
        for i in sorted(free):
            r = regions[i]
            total[i], before[i] = r["hits"], None
            for j in range(i - 1, -1, -1):
                if r["first"] - regions[j]["p"] > most:
                    break
                if j in free and regions[j]["t"] < r["t0"] and total[j] + r["hits"] > total[i]:
                    total[i], before[i] = total[j] + r["hits"], j
        i = max(total, key=lambda x: (total[x], -x))
        if before[i] is None:  # no two regions go together any more
            return out
        chain = []
        while i is not None:
            chain.append(i)
            i = before[i]
        out.append(chain[::-1])
        free -= set(chain)
    return out


def finder(index: dict, band: int, min_coverage: float, whole_below: int = 16, least_hits: float = 0.03):
    """A function from the word lists of some documents to their matches, by document.

    A template is a candidate if a share `least_hits` of its places is hit, and
    the document has words enough. One of fewer than `whole_below` words must
    match whole: a changed word would make it another license's.
    """
    memo = Memo(code)
    known = {n: Filter(np.fromiter(g["postings"], np.uint64, len(g["postings"]))) for n, g in index["groups"].items()}

    def measure(words: list[bytes], key: tuple[str, int], hits: list[tuple[int, int]]) -> tuple[int, int, set] | None:
        template, regions = index["words"][key], []
        least = len(template) * (min_coverage if len(template) >= whole_below else 1.0)
        if len(words) < least or len({t for _, t in hits}) < least_hits * len(template):
            return None
        if exact := {p - t for p, t in hits if words[p - t : p - t + len(template)] == template and p >= t}:
            covered = [(p, t) for p, t in hits if not any(s <= p < s + len(template) for s in exact)]
            rest = measure(words, key, covered) if covered else None
            return len(template), len(template), {(s, len(template)) for s in exact} | (rest[2] if rest else set())
        places: dict[int, list[int]] = {}
        for p, t in sorted(set(hits)):
            places.setdefault(p, []).append(t)
        for p, options in places.items():
            last = regions[-1] if regions else None
            # a region goes on while the template does, near the last diagonal
            on = [t for t in options if last and t > last["t"] and abs(p - t - last["d"]) <= band]
            t = min(on, key=lambda t: abs(p - t - last["d"])) if on else options[0]
            if not on:
                regions.append({"low": p - t, "high": p - t, "start": p - t, "first": p, "t0": t, "hits": 0})
            last = regions[-1]
            last.update(hits=last["hits"] + 1, p=p, t=t, d=p - t, low=min(last["low"], p - t), high=max(last["high"], p - t))
        alone = []
        for i, r in enumerate(regions):  # each between its neighbours' hits
            first = max(0, r["low"] - band, *(x["p"] + 1 for x in regions[max(0, i - 1) : i] if x["p"] < r["start"]))
            end = min(r["high"] + len(template) + band, *(max(r["p"] + 1, x["start"]) for x in regions[i + 1 : i + 2]), len(words))
            region = words[first:end]
            matched, a, b = align(template, region, r["low"] - band - first, r["high"] + band - first)
            alone.append((matched, first + a, b - a + 1))
            r.update(whole=matched == len(template), words=(first, end))
        parts = [i for i, r in enumerate(regions) if not r["whole"]]
        for chain in chains([regions[i] for i in parts], len(template)):
            members = [parts[i] for i in chain]
            own = [regions[i] for i in members]
            first, end = own[0]["words"][0], max(r["words"][1] for r in own)
            diagonals = sorted({d - first for r in own for d in range(r["low"] - band, r["high"] + band + 1)})
            matched, a, b = align_bands(template, words[first:end], diagonals)
            if matched > max(alone[i][0] for i in members):
                for i in members:
                    alone[i] = (matched, first + a, b - a + 1)
        found = [x for x in alone if x[0] >= least]
        return (max(m for m, _, _ in found), len(template), {(a, n) for _, a, n in found}) if found else None

    def licenses_of(words: list[bytes], hits: dict[tuple[str, int], list]) -> list[dict]:
        """A match for each name: the coverage of its best wording, the spans of all."""
        by_name: dict[str, list] = {}
        for key, x in sorted(hits.items()):
            if m := measure(words, key, x):
                by_name.setdefault(key[0], []).append(m)
        out = []
        for name, found in by_name.items():
            matched, size, _ = max(found, key=lambda m: (m[0] / m[1], m[0]))
            out.append({"license": name, "coverage": matched / size, "matched_words": matched, "spans": [{"start": a, "length": n} for a, n in sorted(set().union(*(m[2] for m in found)))]})
        return out

    def find(texts: list[list[bytes]]) -> list[list[dict]]:
        memo.trim()
        words = [w for t in texts for w in t]
        ends = np.cumsum([len(t) for t in texts])
        codes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        hits: dict[int, dict[str, list]] = {}
        for length, group in index["groups"].items():
            h = kgrams(codes, group["k"])
            found = known[length].among(h, select(h, group["w"]))
            for p, doc in zip(found.tolist(), np.searchsorted(ends, found, side="right").tolist(), strict=True):
                first = int(ends[doc]) - len(texts[doc])
                if p + group["k"] <= ends[doc]:
                    for key, t in group["postings"][int(h[p])]:
                        hits.setdefault(doc, {}).setdefault(key, []).append((p - first, t))
        return [licenses_of(texts[i], hits.get(i, {})) for i in range(len(texts))]

    return find


def scan(docs: DataFrame, keep: list[str], wordings: dict[str, list[str]] | None = None, k: int = 3, w: int = 3, band: int = 8, min_coverage: float = 0.6, block_bytes: int = 2_000_000) -> DataFrame:
    """A row for each match: docs' `keep` columns, then license, coverage, matched_words and spans (in words). None: templates().

    The wordings are dealt into blocks of about block_bytes. Each block is a
    pass of its own over docs, so a task holds the index of one.
    """
    blocks: list[dict[tuple[str, int], str]] = [{}]
    size = 0
    for name, texts in (templates() if wordings is None else wordings).items():
        if size > block_bytes:  # all wordings of a name are in one block
            blocks.append({})
            size = 0
        for i, text in enumerate(texts):
            blocks[-1][name, i] = text
            size += len(text)
    out = None
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(build(block, k, w))

        def start(shared=shared):
            find = finder(shared.value, band, min_coverage)
            return lambda texts: (find([words_of(t or "", WORDS) for t in texts]),)

        found = append_columns(docs, keep, ["text"], start, [T.StructField("__licenses", T.ArrayType(MATCH))])
        own = [F.col(f"`{c}`") for c in keep]
        part = found.select(*own, F.explode("__licenses").alias("__m")).select(*own, *[F.col(f"__m.{f.name}").alias(f.name) for f in MATCH])
        out = part if out is None else out.unionByName(part)
    return out


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
