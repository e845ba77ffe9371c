"""Reading titles and personal names as people type them; small helpers used inside tasks."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

#: Words before or after a name that are not part of it.
HONORIFICS = {"dr", "prof", "professor", "mr", "mrs", "ms", "phd", "md", "msc", "bsc", "mph", "jr", "sr", "ii", "iii", "dphil", "dsc", "facp", "rn", "mba"}
#: Entries of author lists that name nobody.
NOBODY = re.compile(r"^(?:et al\.?|others|and others|anonymous|anon\.?|n/?a|none|null|unknown|-+|editors?|no authors?.*|.*\b(?:on behalf of|study group|consortium|collaborat\w+|investigators|working group|committee|society|network|trial group|writing group)\b.*)$", re.I)
#: Names of the Greek letters that occur in titles.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "κ": "kappa", "λ": "lambda", "μ": "mu", "ω": "omega", "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i"}
#: First words of notices about another paper, and their kind.
NOTICES = {
    "erratum": "correction", "errata": "correction", "correction": "correction", "corrigendum": "correction", "corrigenda": "correction", "addendum": "correction",
    "retraction": "retraction", "retracted": "retraction", "withdrawal": "retraction", "withdrawn": "retraction", "expression": "retraction",
    "comment": "comment", "commentary": "comment", "comments": "comment", "letter": "comment",
    "response": "response", "reply": "response", "author": "response", "authors": "response", "rebuttal": "response",
}
#: British spellings folded to American ones, in this order; plain strings or patterns.
SPELLING = [("ageing", "aging"), ("isation", "ization"), (re.compile(r"is(e|ed|es|ing)\b"), r"iz\1"), (re.compile(r"ys(e|ed|es|ing)\b"), r"yz\1"), ("our", "or"), ("ll", "l"), ("oe", "e"), ("ae", "e"), (re.compile(r"re(?<=[tb]re)\b"), "er")]
#: Words whose presence does not tell titles apart.
SMALL = {"a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "is", "its", "of", "on", "or", "that", "the", "to", "via", "with"}
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_LETTERS = str.maketrans(GREEK)
_ODD = re.compile(r"[^\x00-\x7f]{2,}")
_TAG = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"[a-z0-9]+")
_LONG = re.compile(r"[^\W\d_]{4,}")
_CUT = re.compile(r"(?:…|\.\s?\.\s?\.)\s*\]?\s*$")
_ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4"}


def _repair(m: re.Match) -> str:
    s = m.group()
    raw = bytearray()
    for c in s:
        try:
            raw += c.encode("cp1252")
        except UnicodeEncodeError:
            if ord(c) > 255:
                return s
            raw.append(ord(c))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return s


def _bare(m: re.Match) -> str:
    return "".join(c for c in m.group() if not unicodedata.combining(c))


def fold(s: str) -> str:
    """Lower case without accents; encoding damage repaired, Greek letters spelled out."""
    if s.isascii():
        return s.lower()
    s = _ODD.sub(_repair, s)
    s = unicodedata.normalize("NFKD", s)
    s = _FOREIGN.sub(_bare, s).lower()  # marks are never among the ASCII characters
    return s if s.isascii() else s.translate(_LETTERS)


@lru_cache(1 << 12)
def _notice(w: str) -> str:
    return NOTICES.get(w) or next((k for n, k in NOTICES.items() if len(n) > 5 and near(w, n, 1)), "")


def title_words(t: str | None) -> tuple[list[str], str, bool, int]:
    """(words, edition, cut, head) of a title.

    edition: the kind of notice and all standing numerals (part and year marks),
    which tell apart parts, updates, corrections and the like. cut: it ends in
    an ellipsis. head: the number of words before a subtitle, 0 without one.
    """
    if not t:
        return [], "", False, 0
    if "&" in t:
        t = html.unescape(html.unescape(t))
    if "<" in t:
        t = _TAG.sub("", t)
    cut = bool(_CUT.search(t))
    s = fold(t)
    for a, b in SPELLING:
        s = s.replace(a, b) if isinstance(a, str) else a.sub(b, s)
    words = _WORD.findall(s)
    kind = ""
    head = s.split(":", 1)[0]
    main = len(_WORD.findall(head)) if ":" in s else 0
    if ":" in s and main <= 4 and words:
        kind = next(filter(None, map(_notice, words[:2])), "")
    marks = [_ROMAN.get(w, w) for w in words if w in _ROMAN or w.isdigit()]
    if kind:
        at = s.find(":", len(head) + 1)
        main = len(_WORD.findall(s[:at])) if at > 0 else 0
    return words, " ".join([kind, *sorted(marks)]).strip(), cut, main if 5 <= main < len(words) else 0


def near(a: str, b: str, most: int) -> bool:
    """Is the edit distance, swaps of neighbours counting one, at most ``most``?"""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    while la > i and lb > i and a[la - 1] == b[lb - 1]:
        la, lb = la - 1, lb - 1
    a, b = a[i:la], b[i:lb]
    if not a or not b:
        return max(len(a), len(b)) <= most
    if most == 1:
        return len(a) == len(b) == 1 or (len(a) == len(b) == 2 and a == b[::-1])
    old2: list[int] = []
    old = list(range(len(b) + 1))
    for x in range(1, len(a) + 1):
        row = [x]
        for y in range(1, len(b) + 1):
            c = min(old[y] + 1, row[y - 1] + 1, old[y - 1] + (a[x - 1] != b[y - 1]))
            if x > 1 and y > 1 and a[x - 1] == b[y - 2] and a[x - 2] == b[y - 1]:
                c = min(c, old2[y - 2] + 1)
            row.append(c)
        if min(row) > most:
            return False
        old2, old = old, row
    return old[-1] <= most


def allowed(a: str, b: str) -> int:
    """Edits under which two words may still be the same word."""
    n = min(len(a), len(b))
    return 2 if n >= 5 else 1 if n >= 4 else 0


def same_titles(a: list[str], b: list[str], cut_a: bool, cut_b: bool, head_a: int = 0, head_b: int = 0) -> int:
    """3: equal but for spaces and small words; 2: but for typing errors; 1: one is cut or lacks its subtitle; 0: different."""
    if not a or not b:
        return 0
    tail = False
    if not cut_a and not cut_b:
        level = 2
        if head_a and not head_b and abs(len(b) - head_a) <= 2 and len(a) > len(b):
            a, level = a[:head_a], 1
        elif head_b and not head_a and abs(len(a) - head_b) <= 2 and len(b) > len(a):
            b, level = b[:head_b], 1
    else:
        level, tail = 1, True
    a, b = [w for w in a if w not in SMALL], [w for w in b if w not in SMALL]
    if tail:
        n = min(len(a), len(b))
        if n < 4 or (len(a) > len(b) and not cut_b) or (len(b) > len(a) and not cut_a):
            return 0
        a, b = a[:n], b[:n]
        if a[-1].startswith(b[-1]) or b[-1].startswith(a[-1]):
            a, b = a[:-1], b[:-1]
    elif "".join(a) == "".join(b):
        return 3 if level == 2 else level
    more, less = list(a), list(b)
    for w in b:
        if w in more:
            more.remove(w)
    for w in a:
        if w in less:
            less.remove(w)
    if not more and not less:
        return level
    if len(more) == len(less) and len(more) <= max(3, len(a) // 3):
        return level if all(near(x, y, allowed(x, y)) for x, y in zip(more, less)) else 0
    x, y = "".join(more), "".join(less)
    return level if len(more) + len(less) <= 6 and near(x, y, min(2, len(x) // 5)) else 0


@lru_cache(1 << 15)
def name_tokens(n: str) -> tuple[tuple[str, ...], ...]:
    """What ``person_tokens`` has of one entry; names recur, so a worker keeps the latest."""
    if NOBODY.match(n.strip()):
        return ()
    people = (tuple(x for x in _LONG.findall(fold(one)) if x not in HONORIFICS) for one in n.split(";"))
    return tuple(w for w in people if w)


def person_tokens(names) -> list[list[str]]:
    """Long words of every person of an author list, in order; non-persons are left out."""
    if names is None:
        return []
    return [list(w) for n in names if n for w in name_tokens(n)]
