"""Rows and brute-force versions that the tests share."""

from __future__ import annotations

import re

import public_tokenizers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "", "en", "a", 0),
    (2, None, "en", "a", None),
    (3, "  \t\n ", None, None, 5),
    (4, "one two", "en", "b", 7),
    (5, "One TWO", "en", "b", 7),
    (6, "x" * 200_000, "en", "b", 200_000),
    (7, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3000, "de", "b", 1),
    (8, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3000, "de", "b", 1),
    (9, "Ünï çødé 数据     \x1c \U0001f600 'll 12345", "xx", "c", 3),
    (10, "one two", "en", "b", 7),
]


def brute_groups(rows, k=4, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b]:
                common_ = len(sets[a] & sets[b])
                if 100 * common_ >= percent * (len(sets[a]) + len(sets[b]) - common_):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def brute_spans(text):
    out = []
    for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.A):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def reference_encoding():
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
