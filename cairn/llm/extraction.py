"""Main text of HTML pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi.

Features are the tags of a block and its ancestors, words of their class, id and role, and the block's text: length,
links, punctuation. The field is trained on the driver on pages made and labelled by rule (``labelled_pages``), the
same in each session, and is a few hundred numbers; pages are then read one by one in Arrow batches.

Defined cases: null or empty html, and pages of which no block is main text, give an empty text; repeated rows are
read each; broken markup is read as far as it goes; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import labelled_pages as made
from cairn.llm.crf import Chain
from cairn.llm.dom import Block, Element, blocks
from cairn.llm.shared import read

PAGES = 300
_TAGS = "p div h1 h2 h3 li td th pre blockquote figcaption label button option title legend dt dd summary".split()
_ABOVE = "nav header footer aside form article main section ul ol table head body blockquote dialog select figure menu details".split()
_NAMES = {k: frozenset(w for name in names for w in name.split("-")) for k, names in (("menu", made.MENU), ("ads", made.ADS), ("notice", made.NOTICES), ("aside", made.ASIDES), ("comments", made.COMMENTS), ("foot", made.FEET), ("head", made.HEADS), ("body", made.BODIES))}
N_FEATURES = len(_TAGS) + 2 * len(_ABOVE) + 2 * len(_NAMES) + 14
_MARKS = frozenset(("nav", "header", "footer", "aside", "form", "article", "main", "section", "head", "dialog"))


def _notes(inside: Element | None) -> tuple:
    """What the path down to an element tells: tags in it that are features or titles, the last mark, the depth of the last element with words of each kind.

    Noted on each element from those of the one around it, so a path costs its length once, however many blocks it has.
    """
    chain = []
    while inside is not None and inside.notes is None:
        chain.append(inside)
        inside = inside.above
    notes = inside.notes if inside is not None else (frozenset(), None, (0,) * len(_NAMES))
    for e in reversed(chain):
        tags, mark, last = notes
        if e.tag not in tags and (e.tag in _ABOVE or e.tag == "title"):
            tags = tags | {e.tag}
        if e.words:
            last = tuple(e.depth if names.intersection(e.words) else d for names, d in zip(_NAMES.values(), last, strict=True))
        e.notes = notes = (tags, e.tag if e.tag in _MARKS else mark, last)
    return notes


def _of_path(inside: Element | None) -> np.ndarray:
    out = np.zeros(N_FEATURES)
    tags, mark, last = _notes(inside)
    if inside is not None and inside.tag in _TAGS:
        out[_TAGS.index(inside.tag)] = 1
    k = len(_TAGS)
    for t in tags - {"title"}:
        out[k + _ABOVE.index(t)] = 1
    k += len(_ABOVE)
    if mark:
        out[k + _ABOVE.index(mark)] = 1
    k += len(_ABOVE)
    for i, depth in enumerate(last):
        if depth:
            out[k + i] = 1
            out[k + len(_NAMES) + i] = 1 / (1 + inside.depth - depth)
    return out


def features(page: list[Block]) -> np.ndarray:
    if not page:
        return np.zeros((0, N_FEATURES))
    out = np.stack([_of_path(b.inside) for b in page])
    k = N_FEATURES - 14
    for i, b in enumerate(page):
        n = len(b.text)
        x = out[i]
        x[k] = 1
        x[k + 1] = np.log1p(n) / 5
        x[k + 2] = n < 25
        x[k + 3] = n > 200
        x[k + 4] = min(1.0, b.linked / n)
        x[k + 5] = b.linked >= n * 0.8
        x[k + 6] = b.text[-1] in ".!?"
        x[k + 7] = b.text[0] == "©"
        x[k + 8] = "©" in b.text
        x[k + 9] = i == 0
        x[k + 10] = i == len(page) - 1
        tags = _notes(b.inside)[0]
        x[k + 11] = "title" not in tags and (b.inside is None or b.inside.depth <= 2)
        x[k + 12] = b.text.count(",") > 2
        x[k + 13] = bool(tags & {"article", "main"})
    return out


def labelled_blocks(seed: int) -> tuple[list[Block], np.ndarray]:
    parts = made.page(seed)
    ends = np.cumsum([len(h) for h, _ in parts])
    whole = blocks("".join(h for h, _ in parts))
    return whole, np.array([parts[int(np.searchsorted(ends, b.start, side="right"))][1] for b in whole], int)


def train(pages: int = PAGES) -> Chain:
    data = []
    for seed in range(pages):
        whole, labels = labelled_blocks(seed)
        if whole:
            data.append((features(whole), labels))
    chain = Chain(N_FEATURES)
    chain.fit(data)
    return chain


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n\n".join(b.text for b, y in zip(found, chain.decode(features(found)), strict=True) if y)


def extract(pages: DataFrame, chain: Chain) -> DataFrame:
    """``page_id, url, text`` of each row of ``pages`` (page_id, url, html)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(h.as_py(), chain) for h in b.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), texts], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(rows, "page_id long, url string, text string")


def op7_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"), train()).withColumn("n_chars", F.length("text").cast("long"))
