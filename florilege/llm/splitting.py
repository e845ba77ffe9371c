"""Cutting oversized texts at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import tokens as K

#: Strengths of the cuts: before a heading, after a blank line, a line end, a sentence end, a blank, and anywhere else.
HEADING, PARAGRAPH, LINE, SENTENCE, WORD, NONE = 5, 4, 3, 2, 1, 0
_HEADING = re.compile(r"(?:\r\n|\n|\r)(?=#{1,6}[ \t]\S|<h[1-6][ >])")
_PARAGRAPH = re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*")
_LINE = re.compile(r"\r\n|\n|\r")
_SENTENCE = re.compile(r"[.!?。！？]['\")\]”’]*\s+")
_WORD = re.compile(r"\s+")


def strengths(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(character offsets, strengths) of the natural boundaries; a cut is just before the offset."""
    at, power = [], []
    for pattern, s in ((_WORD, WORD), (_SENTENCE, SENTENCE), (_LINE, LINE), (_PARAGRAPH, PARAGRAPH), (_HEADING, HEADING)):
        ends = [m.end() for m in pattern.finditer(text)]
        at += ends
        power += [s] * len(ends)
    return np.array(at, "i8"), np.array(power, "i1")


class StrongestCut:
    """Sparse table for range-maximum queries over strengths; of equal ones the rightmost is found."""

    def __init__(self, strength: np.ndarray):
        n = len(strength)
        key = strength.astype("i8") * (n + 1) + np.arange(n)
        self.size, self.rows = n, [key]
        step = 1
        while 2 * step <= n:
            last = self.rows[-1]
            self.rows.append(np.maximum(last[:-step], last[step:]))
            step *= 2

    def query(self, a: int, b: int) -> int:
        """Position of the strongest cut in [a, b], a <= b."""
        k = (b - a + 1).bit_length() - 1
        row = self.rows[k]
        return int(max(row[a], row[b - (1 << k) + 1]) % (self.size + 1))


def pieces(text: str, limit: int, overlap: int, least: float, encoder, width: np.ndarray) -> list[tuple[int, int, int]]:
    """(first character, end, tokens) of the pieces; [] for a text within the limit.

    Cuts lie on token ends that are also character ends. From its start a piece
    may end at any token in (least * limit, limit]; the strongest boundary there
    wins, the rightmost of equal ones. The next piece starts ``overlap`` tokens
    before that cut, at the next token end that is a character end.
    """
    ids = np.array(K.encode(text, encoder), "i8")
    if len(ids) <= limit:
        return []
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1")
    ends = np.r_[0, np.cumsum(width[ids])]
    lead = np.r_[(raw & 0xC0) != 0x80, True]
    char_of = np.cumsum(lead) - 1  # byte offset -> character offset
    good = lead[ends]
    chars = char_of[ends]
    at, power = strengths(text)
    best = np.full(len(text) + 1, NONE, "i1")
    np.maximum.at(best, at, power)
    # A token that begins with the blank belongs to the right: its cut counts as the boundary after that blank.
    right = np.minimum(chars + 1, len(text))
    blank = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 32
    spaced = np.r_[blank, False][chars]
    strength = np.where(good, np.maximum(best[chars], np.where(spaced, best[right], NONE)), -1)
    table = StrongestCut(strength)
    out, a, n = [], 0, len(ids)
    while True:
        if n - a <= limit:
            out.append((int(chars[a]), int(chars[n]), n - a))
            return out
        b = table.query(a + max(overlap + 1, int(least * limit)), a + limit)
        if not good[b]:  # no character ends in the whole window
            b = a + limit
        out.append((int(chars[a]), int(chars[b]), b - a))
        back = max(b - overlap, a + 1)
        while back < b and not good[back]:
            back += 1
        a = back


def split_oversized(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", limit: int = 512, overlap: int = 64, least: float = 0.5, folder: str = K.TOKENIZERS, vocabulary: str = K.VOCABULARY
) -> DataFrame:
    """(ident, piece, n_pieces, start_char, end_char, n_tokens, text): ordered pieces of the texts above ``limit`` tokens.

    Every piece has at most ``limit`` tokens of the public vocabulary, cut with
    a sparse-table range maximum over boundary strengths (heading, paragraph,
    line, sentence, word); consecutive pieces share ``overlap`` tokens (fewer
    only where a character spans tokens). Texts within the limit, empty and NULL
    ones give no row; a text of at most ``limit`` bytes is within it without
    being tokenised. Texts without blanks are cut between tokens. Cutting the
    pieces at start_char and end_char restores the text. Each row is
    independent, so there is no shuffle; repeated rows give repeated pieces.
    """
    if not 0 <= overlap < least * limit:
        raise ValueError("overlap must be smaller than least * limit")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, width = K.load(folder, vocabulary)
        for pdf in it:
            rows = []
            for i, t in zip(pdf[ident], pdf[text]):
                if not t or (len(t) <= limit and len(t.encode("utf-8", "surrogatepass")) <= limit):
                    continue
                own = pieces(t, limit, overlap, least, encoder, width)
                rows += [(i, k, len(own), a, b, n, t[a:b]) for k, (a, b, n) in enumerate(own)]
            yield pd.DataFrame(rows, columns=[ident, "piece", "n_pieces", "start_char", "end_char", "n_tokens", "text"])

    return docs.select(ident, text).mapInPandas(run, f"{ident} {docs.schema[ident].dataType.simpleString()}, piece int, n_pieces int, start_char long, end_char long, n_tokens int, text string")
