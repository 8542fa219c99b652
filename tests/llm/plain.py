"""Plain single-machine versions of what the text operators compute."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile("[^\x20\x09-\x0d]+")


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def contamination(docs: list[str | None], items: list[tuple]) -> list[tuple]:
    windows: dict[tuple, set[str]] = {}
    for item, text in items:
        words = WORD.findall(lower(text))
        size = min(13, len(words))
        for i in range(len(words) - size + 1) if words and item is not None else ():
            windows.setdefault(tuple(words[i : i + size]), set()).add(str(item))
    rows = []
    for text in docs:
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if (w := tuple(words[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[w]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        rows.append((len(words), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(words)))
    return rows


def shingles(text: str | None) -> frozenset:
    words = TOKEN.findall(lower(text))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def smallest_reachable(ids: list[int], linked) -> list[int]:
    """The smallest id of each place's component; ``linked(i, j)`` tells of places."""
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if label[i] != label[j] and linked(i, j):
                label = [label[j] if x == label[i] else x for x in label]
    return [min(ids[k] for k in range(len(ids)) if label[k] == label[i]) for i in range(len(ids))]


def jaccard(docs: list[tuple[int, str | None]]) -> list[tuple]:
    sets = [shingles(t) for _, t in docs]
    link = lambda i, j: bool(sets[i] and sets[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    return [(i, len(s), c) for (i, _), s, c in zip(docs, sets, smallest_reachable([i for i, _ in docs], link))]


PIECE_END = re.compile("[.,;:!?\x0a-\x0d]")
IN_PIECE = re.compile("[^\x20\x09]+")


def phrase_rows(docs: list[tuple], least: int, top: int = 2000, share: int = 100) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) from ``docs`` (text, lang), each phrase counted by itself."""
    count: dict[tuple, int] = {}
    total: dict[str, int] = {}
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in PIECE_END.split(lower(text)):
            words = IN_PIECE.findall(piece)
            total[lang] = total.get(lang, 0) + len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i : i + k]))
                    count[key] = count.get(key, 0) + 1
    found: dict[str, list] = {}
    frequent = {key: a for key, a in count.items() if a >= least}
    for (lang, words), a in frequent.items():
        if len(words) < 2:
            continue
        around = [b for (other, longer), b in frequent.items() if other == lang and len(longer) > len(words)
                  and any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))]
        if any(100 * b >= share * a for b in around):
            continue
        n = total[lang]
        cuts = [(1000 * a * n // (count[lang, words[:k]] * count[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), count[lang, words[:k]], count[lang, words[k:]], n))
    return [
        (lang, rank, phrase.decode(), -a, left, right, n, -score)
        for lang, rows in found.items()
        for rank, (score, a, phrase, left, right, n) in enumerate(sorted(rows)[:top], 1)
    ]


def statistics(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = text or ""
    words = TOKEN.findall(text)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(3)}
    lines = [line for line in text.split("\n") if TOKEN.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), len(lines)


def search(docs: list[tuple], items: list[tuple], top: int = 20) -> list[tuple]:
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    from math import floor, log

    bags = []
    for doc_id, text in docs:
        words = WORD.findall(lower(text))
        bags.append((doc_id, {w: words.count(w) for w in set(words)}, len(words)))
    n, total = sum(size > 0 for _, _, size in bags), sum(size for _, _, size in bags)
    df: dict[str, int] = {}
    for _, bag, _ in bags:
        for w in bag:
            df[w] = df.get(w, 0) + 1
    rows = []
    for item, text in items:
        found = []
        for doc_id, bag, size in bags:
            score = 0
            for w in WORD.findall(lower(text)):
                if w in bag:
                    m = 100 - 25 + 25 * size * n // total
                    score += floor(1000 * log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * bag[w] // (1000 * bag[w] + 12 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        rows += [(item, rank, d, -score) for rank, (score, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return rows
