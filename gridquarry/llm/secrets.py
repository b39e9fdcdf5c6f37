"""Secret scans by a linear-chain conditional random field (operator 9).

Base kinds are found by fixed patterns and always stay. A CRF adds spans: it tags every token of a text as begin, inside
or outside of a secret from its shape, the neighbouring words and features of the whole text, and is decoded by Viterbi.
Scores of a word are remembered, so that those of a text are sums of looked-up rows. A token that is outside in every
best sequence, whatever its neighbours' tags (a bound on what another tag could gain), parts the chain: the runs between
such tokens are decoded one by one, exactly as over the whole text.

The field is trained on the driver from a bounded sample of windows, features and tags made by the tasks: of at most
SAMPLE_DOCS texts with four digits in a row and PLAIN_DOCS others, chosen by hash of doc_id, SAMPLE_WINDOWS windows by a
hash of doc_id, position and words; those that hold a secret of the base kinds are chosen RICH times as often and weigh less by
as much. So that it learns more than the fixed patterns, the sample also holds, made from the same hash: every window with a
base secret once more with its key words and fixed prefixes hidden; and in each PLANT-th other window a planted
secret (letters alone, mixed, base64, groups of a code, short ones after a cue, with and without key words) or a decoy
(addresses, numbers, dates, names of code and files, words in capitals), which is outside. Weights are a few thousand doubles.

Words count whole, however long. Scanning covers every whole text, in steps of STEP characters that end at white space, so
that memory beyond the text is a few numbers a token. Nulls are empty texts; empty texts have no spans; spans of one start are ordered by
kind; repeated rows are scanned alike; extra columns are ignored. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.llm.common import frugal, sliced

KINDS = ("assign", "access", "hex", "crf")
#: Fixed patterns.
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
HINTS = ("passw", "secret", "token", "apikey", "api_key")
#: A token with the white space before it.
PIECE = re.compile(r"\s*(?:[A-Za-z0-9+/_-]+|[^\sA-Za-z0-9+/_-])")
DIGITS = re.compile(r"[0-9]+")
BODY = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
LEAST = 8
DIMS = 1 << 13
#: Most texts (with four digits in a row, and others) and windows of the training sample.
SAMPLE_DOCS, PLAIN_DOCS, SAMPLE_WINDOWS = 4000, 1000, 12_000
#: Least tokens of a window, and how many times as often one with a secret is chosen.
WINDOW, RICH = 8, 16
#: Of how many windows one gets a planted secret or decoy, and what all windows as they are, with secrets and with decoys weigh.
PLANT, REAL, PLANTED, DECOYS = 2, 800.0, 300.0, 100.0
#: Words remembered by a task, the longest of them, and characters of a text that are looked at in one step.
REMEMBERED, LONGEST, STEP = 200_000, 256, 1 << 18
#: Rounds of training after which all windows are looked at again, and the least slope by which one still teaches.
SETTLED, TAUGHT = 10, 1e-5
#: Log-odds that a secret must have beyond what the sample says.
MARGIN = 1.5
# ---- fixed values: words before secrets, and what public kinds of keys begin with ---------------------------------
CUES = (
    "passphrase password passwd pwd pass passcode pin credential credentials login auth authorization bearer secret token key apikey api_key access_key private_key "
    "client_secret signature webhook session code licence license recovery seed Passwort Kennwort contraseña clave mot clé"
).split()
LINKS = ("", ":", "=", "is", ":=", "->", "ist", "est", "es")
PREFIXES = "ghp_ gho_ sk_live_ xoxb- glpat- npm_ AIza ASIA eyJ".split()
# -------------------------------------------------------------------------------------------------------------------
KEYS = frozenset(("password", "passwd", "secret", "token", "apikey", "api_key", "key"))
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True


def _has_hex(text: str) -> bool:
    """Whether 16 neighbouring bytes are lower-case hex digits."""
    h = _HEX[np.frombuffer(text.encode(), np.uint8)]
    for step in (1, 2, 4, 8):
        if len(h) <= step:
            return False
        h = h[:-step] & h[step:]
    return bool(h.any())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if _has_hex(text):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Maximal runs of the secret alphabet with a digit, of LEAST characters or more."""
    out = []
    end = 0
    for m in DIGITS.finditer(text):
        i, j = m.span()
        if i < end:
            continue
        while i > end and text[i - 1] in BODY:
            i -= 1
        while j < len(text) and text[j] in BODY:
            j += 1
        end = j
        if j - i >= LEAST:
            out.append((i, j))
    return out


_CLASS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "A" * 26 + "a" * 26 + "9" * 10)
_REPEATED = re.compile(r"(.)\1+", re.S)
#: All that a word of the secret alphabet may hold but consonants, as spaces.
_SOFT = str.maketrans(dict.fromkeys("aeiouyAEIOUY0123456789+/_-", " "))


def _classes(word: str) -> str:
    """The classes of a word's characters, runs of one as one."""
    kinds = word.translate(_CLASS) if word.isascii() else "".join("A" if c.isupper() else "a" if c.islower() else "9" if c.isdigit() else c for c in word)
    return _REPEATED.sub(r"\1", kinds)


def _shape(word: str) -> str:
    """The first twelve runs of classes."""
    return _classes(word)[:12]


def _ids(names: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(n.encode()) % DIMS for n in names], np.int32)


def pieces(text: str) -> list[str]:
    """All tokens of a text, each with the white space before it."""
    return PIECE.findall(text.rstrip())


def traits(word: str) -> tuple:
    """What a word itself shows, of all its characters."""
    n = len(word)
    hard = max(map(len, word.translate(_SOFT).split()), default=0)
    if word.isalpha() and word.islower():  # most words, by the same rules
        return (
            "a", min(n // 4, 12) if n < 64 else 13 + min(n.bit_length() - 7, 6), 0, not word.strip("abcdef"), n >= 16, False, False, True,
            10 * len(set(word)) // min(n, 24), False, 1, min(hard, 8), 10 // n if n >= 6 else -1,
        )
    runs = _classes(word)
    digits = 0 if word.isalpha() else sum(map(str.isdigit, word))
    upper = runs != "a" and not digits and word.isupper() and word.isalpha() or bool(digits) and all(c.isupper() or c.isdigit() for c in word)
    return (
        runs[:12], min(n // 4, 12) if n < 64 else 13 + min(n.bit_length() - 7, 6), 10 * digits // n, not word.strip("0123456789abcdef"), n >= 16, upper, word[:4] == "AKIA", digits < n,
        10 * len(set(word)) // min(n, 24), digits > 0 and n >= LEAST, min(len(runs), 12), min(hard, 8), 10 * len(runs) // n if n >= 6 else -1,
    )


def word_features(shown: tuple) -> list[str]:
    """Names of traits."""
    shape, length, digits, hexes, long, upper, akia, letters, variety, likely, runs, hard, turns = shown
    return [
        "bias",
        f"shape {shape}",
        f"length {length}",
        f"digits {digits}",
        f"hex {hexes} {long}",
        f"upper {upper} {akia}",
        f"letters {letters}",
        f"variety {variety}",
        f"likely {likely}",
        f"runs {runs} {min(length, 4)}",
        f"hard {hard} {upper}",
        f"turns {turns} {long}",
    ]


#: Check sums of what the names of neighbours' features begin with.
_AROUND = [zlib.crc32(n) for n in (b"before1 ", b"before2 ", b"before3 ", b"after ")]


def around(low: str) -> list[int]:
    """Hashed features that a word gives to its neighbours."""
    data = low.encode("utf-8", "surrogatepass")
    return [zlib.crc32(data, a) % DIMS for a in _AROUND]


class Word:
    """Hashed features of a piece: its own, those it gives to its neighbours, and whether it is a key word or follows a space."""

    __slots__ = ("own", "around", "keyed", "spaced", "size", "length")

    def __init__(self, piece: str):
        word = piece.lstrip()
        low = word.lower() if len(word) < 16 else _shape(word)
        self.own = _ids(word_features(traits(word)))
        self.around = around(low)
        self.keyed, self.spaced = low in KEYS, len(word) < len(piece)
        self.size, self.length = len(piece), len(word)


_SPACE = _ids([f"space {a} {b}" for a in (False, True) for b in (False, True)])
_KEYED = _ids([f"keyed {a}" for a in (False, True)])
#: Features of a token: its word's (OWN), space, density, three words before, one after, keyed. DIMS stands for none.
OWN = 12
WIDTH = OWN + 1 + 1 + 3 + 1 + 1


def features(words: list[Word], first: int, last: int, density: int, trails: bool = False) -> np.ndarray:
    """Hashed features of words first to last (exclusive), a row each; a feature hashed twice counts twice."""
    out = np.full((last - first, WIDTH), DIMS, np.int16)
    dense = _ids([f"density {density}"])[0]
    for row, t in zip(out, range(first, last)):
        after = words[t + 1] if t + 1 < len(words) else None
        before = words[max(0, t - 3) : t][::-1]
        row[:OWN] = words[t].own
        row[OWN] = _SPACE[2 * words[t].spaced + (after.spaced if after else trails)]
        row[OWN + 1] = dense
        for k, w in enumerate(before):
            row[OWN + 2 + k] = w.around[k]
        if after:
            row[OWN + 5] = after.around[3]
        row[OWN + 6] = _KEYED[int(any(w.keyed for w in before))]
    return out


def density(text: str, spans: list[tuple[int, int]]) -> int:
    """Candidates for each 10,000 characters, in powers of two."""
    return min(8, int(np.log2(1 + 10_000 * len(spans) / max(len(text), 200))))


def labels(text: str, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Tags of the tokens from the base spans."""
    tags = np.zeros(len(starts), np.int32)
    for i, kind, j in base_spans(text):
        if kind == 0:
            i = ASSIGN.match(text, i).start(1)
        lo, hi = np.searchsorted(ends, i, "right"), np.searchsorted(starts, j, "left")
        fresh = np.flatnonzero(tags[lo:hi] == OUTSIDE) + lo
        tags[fresh] = np.where(fresh == lo, BEGIN, INSIDE)
    return tags


def cuts(text: str) -> tuple[list[str], np.ndarray, list[int]]:
    """Pieces and tags of a text, and where its windows start: every WINDOW tokens, but not inside a secret."""
    parts = pieces(text)
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    starts = ends - [len(p.lstrip()) for p in parts] if parts else ends
    tags = labels(text, ends, starts)
    at = [0]
    while at[-1] + WINDOW < len(parts):
        i = at[-1] + WINDOW
        while i < len(parts) and tags[i] == INSIDE:
            i += 1
        at.append(i)
    return parts, tags, [i for i in at if i < len(parts)]


def windows(text: str) -> list[tuple[list[np.ndarray], list[int]]]:
    """Features and tags of each window, tags from the base spans."""
    parts, tags, at = cuts(text)
    words, d = [Word(p) for p in parts], density(text, candidates(text))
    out = []
    for i, j in zip(at, [*at[1:], len(parts)]):
        rows = features(words, i, j, d, bool(text[-1:].isspace()))
        out.append(([r[r < DIMS] for r in rows], tags[i:j].tolist()))
    return out


class Field:
    """Weights of the chain: emit[tag, feature] and move[tag before, tag]; outside scores 0."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def viterbi(self, run: list[np.ndarray]) -> list[int]:
        """The best tags of a run between two outside tokens; ties go to the lower tag."""
        return self.best(np.stack([self.emit[:, f].sum(1) for f in run]))

    def best(self, emits: np.ndarray) -> list[int]:
        """The same from the scores of each token's tags."""
        score, back = None, []
        for e in emits:
            if score is None:
                score = e + self.move[OUTSIDE]
            else:
                way = score[:, None] + self.move
                back.append(way.argmax(0))
                score = way.max(0) + e
        tag = int((score + self.move[:, OUTSIDE]).argmax())
        tags = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            tags.append(tag)
        return tags[::-1]

    def outside(self, emits: np.ndarray) -> np.ndarray:
        """Tokens that are outside in every best sequence: with any other tag, outside in its place (and begin for an inside that follows) scores more.

        Beside a token that is outside for sure, and at the ends, the neighbour's tag is known, so the bound is looked at again."""
        m = self.move
        follows = np.append((emits[1:, INSIDE] - emits[1:, BEGIN]), -np.inf)
        sure = np.ones(len(emits) + 2, bool)  # with the tokens' neighbours at both ends
        sure[1:-1] = False
        look = np.arange(len(emits))
        for _ in range(3):
            before, after = sure[look], sure[look + 2]
            e, next_ = emits[look], follows[look]
            gain = np.full(len(look), -np.inf)
            for tag in (BEGIN, INSIDE):
                into = np.where(before, m[OUTSIDE, tag] - m[OUTSIDE, OUTSIDE], (m[:, tag] - m[:, OUTSIDE]).max())
                on = (m[tag, :INSIDE] - m[OUTSIDE, :INSIDE]).max()
                inside = m[tag, INSIDE] - m[OUTSIDE, BEGIN] + (m[INSIDE] - m[BEGIN]).max()
                ends = np.where(after, m[tag, OUTSIDE] - m[OUTSIDE, OUTSIDE], np.maximum(on, inside + next_))
                gain = np.maximum(gain, e[:, tag] - e[:, OUTSIDE] + into + ends)
            now = gain < -1e-9
            if not now.any():
                break
            sure[look[now] + 1] = True
            look = look[~now]
        return sure[1:-1]

    def decoded(self, emits: np.ndarray) -> list[tuple[int, list[int]]]:
        """The best tags of a whole text as runs (first token, tags); tokens in no run are outside."""
        open_ = np.flatnonzero(~self.outside(emits))
        if not len(open_):
            return []
        first = np.flatnonzero(np.diff(open_, prepend=-2) > 1)
        last = np.append(first[1:], len(open_)) - 1
        alone = first[first == last]  # runs of one token, all at once
        tags = (emits[open_[alone]] + (self.move[OUTSIDE] + self.move[:, OUTSIDE])).argmax(1)
        out = [(int(open_[i]), [int(tag)]) for i, tag in zip(alone[tags != OUTSIDE], tags[tags != OUTSIDE])]
        out += [(int(open_[i]), self.best(emits[open_[i] : open_[j] + 1])) for i, j in zip(first, last) if i < j]
        return sorted(out)


class Scores(dict):
    """The scores that a field gives to words, remembered by piece: a row of its own scores, those it gives to the three
    words after it and to the one before, and whether it is a key word or follows a space, its size and length."""

    def __init__(self, field: Field):
        self.field = field
        emit = field.emit
        self.turned = np.ascontiguousarray(emit.T)
        self.space, self.keyed = emit[:, _SPACE].T, emit[:, _KEYED].T
        self.dense = emit[:, _ids([f"density {d}" for d in range(9)])].T
        self.kinds: dict[tuple, int] = {}
        self.own = np.zeros((0, 3))
        self.n = 0
        self.score, self.flags, self.used = np.zeros((1024, 15)), np.zeros((1024, 4), np.int32), np.zeros(1024, np.int32)
        self.fresh()

    def thin(self) -> None:
        """Forgets all but the words that two texts or more have used, the most used half at most; earlier uses then count half."""
        used = self.used[: self.n]
        stays = np.argsort(-used, kind="stable")[: min(REMEMBERED // 2, int((used > 1).sum()))]
        at = np.full(self.n, -1)
        at[stays] = np.arange(len(stays))
        kept = [(word, int(at[i])) for word, i in self.items() if at[i] >= 0]
        self.clear()
        self.update(kept)
        self.n = n = len(stays)
        self.score[:n], self.flags[:n], self.used[:n] = self.score[stays], self.flags[stays], used[stays] // 2
        self.used[n:] = 0
        self.kinds, self.own = {}, np.zeros((0, 3))

    def fresh(self) -> None:
        """Words that are known but have no row yet: their own kind, what they give to neighbours and flags; copies of others."""
        self.new: tuple[list, list, list, list] = ([], [], [], [])
        self.copies: list[tuple[int, int, int]] = []
        self.new_kinds: list[tuple] = []

    def settle(self) -> None:
        """Rows for the new words, all at once."""
        while self.n > len(self.flags):
            self.score = np.concatenate([self.score, np.zeros_like(self.score)])
            self.flags = np.concatenate([self.flags, np.zeros_like(self.flags)])
            self.used = np.concatenate([self.used, np.zeros_like(self.used)])
        if self.new_kinds:
            ids = np.stack([_ids(word_features(k)) for k in self.new_kinds])
            self.own = np.concatenate([self.own, self.turned[ids].sum(1)])
        at, kinds, beside, flags = self.new
        if at:
            self.score[at, :3] = self.own[kinds]
            self.score[at, 3:] = self.turned[np.array(beside)].reshape(len(at), 12)
            self.flags[at] = flags
        if self.copies:
            at, known, size = np.array(self.copies).T
            self.score[at], self.flags[at] = self.score[known], self.flags[known]
            self.flags[at, 1], self.flags[at, 2] = 1, size
        self.fresh()

    def __missing__(self, piece: str) -> int:
        n, word = self.n, piece.lstrip()
        size, length = len(piece), len(word)
        if size > length and (known := self.get(word)) is not None:
            self.copies.append((n, known, size))
        else:
            shown = traits(word)
            if (kind := self.kinds.get(shown)) is None:
                kind = self.kinds[shown] = len(self.kinds)
                self.new_kinds.append(shown)
            low = word.lower() if length < 16 else shown[0]
            at, kinds, beside, flags = self.new
            at.append(n)
            kinds.append(kind)
            beside.append(around(low))
            flags.append((low in KEYS, length < size, size, length))
        self.n += 1
        if size <= LONGEST:
            self[piece] = n
        return n

    def rows(self, text: str):
        """Rows of scores and flags of a text's tokens, some at a time."""
        at, text = 0, text.rstrip()
        while at < len(text):
            end = len(text)
            if end - at > STEP:  # a token does not go on beyond white space
                m = re.compile(r"\s").search(text, at + STEP)
                end = m.start() if m else end
            if self.n > REMEMBERED:
                self.thin()
            found = np.fromiter(map(self.__getitem__, PIECE.findall(text, at, end)), np.int64)
            self.settle()
            self.used[found] += 1
            yield self.score[found], self.flags[found]
            at = end

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of each token's tags, and the tokens' starts and ends."""
        dense = self.dense[density(text, candidates(text))]
        emits, flags = [], []
        before, last = np.zeros((3, 12)), None  # what the words before give, and the row to which the next one adds
        for score, flag in self.rows(text):
            e = score[:, :3] + dense
            held = np.concatenate([before, score[:, 3:]])
            for k in (1, 2, 3):
                e += held[3 - k : len(held) - k, 3 * k - 3 : 3 * k]
            e[:-1] += score[1:, 12:]
            if last is not None:
                last += score[0, 12:]
            before, last = held[-3:], e[-1]
            emits.append(e)
            flags.append(flag)
        e, flags = (emits[0], flags[0]) if len(emits) == 1 else (np.concatenate(emits), np.concatenate(flags))
        keyed, spaced, size, length = flags.T
        e += self.space[2 * spaced + np.append(spaced[1:], int(text[-1:].isspace()))]
        near = np.zeros(len(e), np.int32)
        for k in (1, 2, 3):
            near[k:] |= keyed[:-k]
        e += self.keyed[near]
        ends = np.cumsum(size, dtype=np.int64)
        return e, ends - length, ends


def fitted(sample: list[tuple[list[np.ndarray], list[int]]], weights: list[float] | None = None, rounds: int = 60, l2: float = 3e-5, rate: float = 0.7) -> Field:
    """Maximum conditional likelihood by full-batch Adagrad; runs of equal length are computed together; each weighs the same or as weights say."""
    emit, move = np.zeros((3, DIMS)), np.zeros((3, 3))
    move[OUTSIDE, INSIDE] = -1e3  # inside follows begin or inside only
    if not sample:
        emit[OUTSIDE, _ids(["bias"])] = 1.0
        return Field(emit, move)
    by: dict[int, list[int]] = {}
    for i, (_, tags) in enumerate(sample):
        by.setdefault(len(tags), []).append(i)
    groups = []
    own = np.full(len(sample), 1 / len(sample)) if weights is None else np.array(weights)
    for n, members in by.items():
        width = max(len(f) for i in members for f in sample[i][0])
        x = np.full((n, len(members), width), DIMS, np.int16)
        for r, i in enumerate(members):
            for t, f in enumerate(sample[i][0]):
                x[t, r, : len(f)] = f
        groups.append((x, np.array([sample[i][1] for i in members]).T, own[members], np.ones(len(members), bool)))
    ge, gm = np.full((3, DIMS), 1e-8), np.full((3, 3), 1e-8)
    for k in range(rounds):
        padded = np.concatenate([emit, np.zeros((3, 1))], 1).T.copy()
        de, dm = np.zeros((3, DIMS + 1)), np.zeros((3, 3))
        ways = np.exp(move)
        for x, y, w, open_ in groups:
            every = k % SETTLED == 0 or open_.all()  # windows that are right by far are looked at now and then
            if not every:
                x, y, w = x[:, open_], y[:, open_], w[open_]
            slope = _slopes(x, y, w, padded, ways, dm)
            if k % SETTLED == 0:
                open_[:] = np.abs(slope).max((0, 2)) > TAUGHT
            live = np.abs(slope).max(2) > 0
            rows, slope = x[live].ravel(), slope[live]
            for tag in (BEGIN, INSIDE):
                de[tag] += np.bincount(rows, np.repeat(slope[:, tag], x.shape[2]), DIMS + 1)
        g = de[:, :DIMS] - l2 * emit
        g[OUTSIDE] = 0
        ge += g * g
        emit += rate * g / np.sqrt(ge)
        gm += dm * dm
        dm[OUTSIDE, INSIDE] = 0
        move += rate * dm / np.sqrt(gm)
    return Field(emit, move)


def _slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray, padded: np.ndarray, ways: np.ndarray, dm: np.ndarray) -> np.ndarray:
    """Derivatives of the weighted log-likelihood by the scores of each token's tags, of windows of one length (token, window, feature); adds those by the moves to dm. Scaled forward and backward sums."""
    n, m, width = x.shape
    e = np.zeros((n, m, 3))
    for c in range(width):
        e += padded[x[:, :, c]]
    e = np.exp(e - e.max(2, keepdims=True))
    alpha, beta = np.empty((n, m, 3)), np.empty((n, m, 3))
    alpha[0] = e[0] * ways[OUTSIDE]
    beta[-1] = ways[:, OUTSIDE]
    for t in range(1, n):
        alpha[t - 1] /= np.maximum(alpha[t - 1].sum(1, keepdims=True), 1e-300)
        alpha[t] = e[t] * (alpha[t - 1] @ ways)
    for t in range(n - 2, -1, -1):
        beta[t] = (e[t + 1] * beta[t + 1]) @ ways.T
        beta[t] /= np.maximum(beta[t].sum(1, keepdims=True), 1e-300)
    p = alpha * beta
    p /= np.maximum(p.sum(2, keepdims=True), 1e-300)
    slope = (np.eye(3)[y] - p) * w[None, :, None]
    dm[OUTSIDE] += slope[0].sum(0)
    dm[:, OUTSIDE] += slope[-1].sum(0)
    for t in range(1, n):
        np.add.at(dm, (y[t - 1], y[t]), w)
        on = e[t] * beta[t]
        z = np.maximum(((alpha[t - 1] @ ways) * on).sum(1), 1e-300)
        dm -= ways * (alpha[t - 1].T @ (on * (w / z)[:, None]))
    return slope


def _word(rng: random.Random, letters: str, least: int, most: int) -> str:
    return "".join(rng.choices(letters, k=rng.randint(least, most)))


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def secret(rng: random.Random) -> tuple[str, int, int]:
    """A text with a made secret, and where the secret is in it."""
    mixed = _LOWER + _UPPER
    kind, cued = rng.randrange(9), rng.random() < 0.6
    if kind == 0:
        value = _word(rng, mixed, 10, 40)
    elif kind == 1:
        value = _word(rng, mixed + _DIGITS, 10, 48)
    elif kind == 2:
        value = _word(rng, mixed + _DIGITS + "+/", 20, 64)
    elif kind == 3:
        value = _word(rng, mixed + _DIGITS + "-_", 16, 48)
    elif kind == 4:
        value = _word(rng, _UPPER + _DIGITS, 16, 40)
    elif kind == 5:
        value = rng.choice(PREFIXES) + _word(rng, mixed + _DIGITS, 16, 40)
    elif kind == 6:
        value, cued = _word(rng, _LOWER + _DIGITS, 10, 32), True
    elif kind == 7:
        value, cued = _word(rng, mixed + _DIGITS, 4, 8) + rng.choice("!@#$%&*?") + _word(rng, mixed + _DIGITS, 2, 6), True
    else:
        value, cued = rng.choice("- ").join(_word(rng, _UPPER + _DIGITS, n, n) for n in [rng.randint(4, 5)] * rng.randint(3, 6)), True
    head = ""
    if cued:
        cue, link = rng.choice(CUES), rng.choice(LINKS)
        cue = rng.choice((cue, cue, cue.upper(), cue.capitalize(), f"{rng.choice(('db', 'my', 'app', 'user'))}_{cue}"))
        head = f" {cue}{rng.choice(('', ' ')) if not link[:1].isalpha() and link else ' '}{link}{' ' if link[:1].isalpha() or rng.random() < 0.7 else ''}"
        head = head if head[-1:].isspace() or link and not link[:1].isalpha() else head + " "
    quote = rng.choice(("", "", "'", '"', "`"))
    head = (head or " ") + quote
    return head + value + quote, len(head), len(head) + len(value)


def decoy(rng: random.Random) -> str:
    """A text that looks like a secret and is none."""
    word = lambda: _word(rng, "aeiourstnl" + _LOWER, 3, 9)
    number = lambda n: _word(rng, _DIGITS, 1, n)
    return " " + (
        lambda: f"{word()}.{word()}{number(3)}@{word()}.{rng.choice(('com', 'org', 'example.net'))}",
        lambda: ".".join(number(3) for _ in range(4)),
        lambda: f"+{number(2)} ({number(3)}) {number(4)}-{number(4)}",
        lambda: f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}:{rng.randint(0, 59):02}",
        lambda: _word(rng, _DIGITS, 4, 15),
        lambda: "".join(word().capitalize() for _ in range(rng.randint(1, 4))),
        lambda: word() + "".join(word().capitalize() for _ in range(rng.randint(1, 3))),
        lambda: rng.choice("_-/").join(word() for _ in range(rng.randint(2, 6))),
        lambda: rng.choice("_- ").join(word().upper() for _ in range(rng.randint(1, 4))),
        lambda: f"{word()}_{number(3)}.{rng.choice(('py', 'txt', 'json', 'png'))}",
        lambda: f"https://www.{word()}.com/{word()}/{word()}-{number(6)}?{word()}={number(3)}",
        lambda: f"v{number(2)}.{number(2)}.{number(2)}-{rng.choice(('beta', 'rc'))}{number(1)}",
        lambda: f"{rng.choice(CUES)} {rng.choice(('', 'of ', 'and ', 'for '))}{word()}",
        lambda: f"{rng.choice(CUES)}: {word()} {word()}",
        lambda: word() + word() + word(),
    )[rng.randrange(15)]()


def planted(near: list[str], first: int, n: int, key: int) -> tuple[list[str], list[int], bool]:
    """Pieces of a window of n tokens from first on with a made secret or decoy put in, its tags, and whether it is a secret."""
    rng = random.Random(key)
    at, real = first + rng.randint(0, n), rng.random() < 0.5
    made, i, j = secret(rng) if real else (decoy(rng), 0, 0)
    parts = pieces(made)
    tags, end = [], 0
    for p in parts:
        start, end = end + len(p) - len(p.lstrip()), end + len(p)
        tags.append(OUTSIDE if end <= i or start >= j else INSIDE if any(tags) else BEGIN)
    return near[:at] + parts + near[at:], [OUTSIDE] * (at - first) + tags + [OUTSIDE] * (first + n - at), real


def hidden(near: list[str], key: int) -> list[str]:
    """Pieces of a window without what the base patterns look for."""
    rng = random.Random(key)
    other = lambda p: p[: len(p) - len(p.lstrip())] + _word(rng, _LOWER, 3, 8)
    return [other(p) if p.lstrip().lower() in KEYS else p.replace("AKIA", _word(rng, _UPPER, 4, 4)) for p in near]


def _ranked(text: str | None, h: int):
    """Rank, whether it holds a secret, tags, first own token, pieces with those around, and a number of its own, of each window."""
    parts, tags, at = cuts(text or "")
    for i, j in zip(at, [*at[1:], len(parts)]):
        near = [" " * (p[:1].isspace()) + p.lstrip() for p in parts[max(0, i - 3) : j + 1]]
        digest = hashlib.blake2b(f"{h} {i} {near}".encode("utf-8", "replace"), digest_size=15).digest()
        held = bool(tags[i:j].any())
        yield int.from_bytes(digest[:7], "little") / 2**56 / (RICH if held else 1), held, tags[i:j].tolist(), min(i, 3), near, int.from_bytes(digest[7:], "little")


#: What a window of the sample is: as it stands without or with a base secret, with a planted secret, with a decoy.
AS_IS, HELD, SECRET, DECOY = 0, 1, 2, 3


def examples(held: bool, tags: list[int], first: int, near: list[str], key: int) -> list[tuple[int, list[str], list[int]]]:
    """What a window gives to the sample: kind, pieces and tags."""
    out = [(HELD if held else AS_IS, near, tags)]
    if held:
        out.append((SECRET, hidden(near, key), tags))
    elif key % PLANT == 0:
        with_, own, real = planted(near, first, len(tags), key)
        out.append((SECRET if real else DECOY, with_, own))
    return out


def _ranks(batches):
    for b in sliced(batches):
        for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in _ranked(text, h)], pa.float64())], ["rank"])


def _sampled(most: float):
    def run(batches):
        known: dict[str, Word] = {}

        def word(piece: str) -> Word:
            if len(known) > REMEMBERED:
                known.clear()
            if (w := known.get(piece)) is None:
                w = Word(piece)
                if len(piece) <= LONGEST:
                    known[piece] = w
            return w

        types = (pa.float64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary())
        for b in sliced(batches):
            for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, d = [], density(text, candidates(text))
                for rank, held, tags, first, near, key in _ranked(text, h):
                    if rank <= most:
                        for kind, parts, own in examples(held, tags, first, near, key):
                            x = features([word(p) for p in parts], first, first + len(own), d)
                            rows.append((rank, key - (1 << 63), kind, own, x.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["rank", "key", "kind", "tags", "features"])

    return run


def sampled(docs: DataFrame) -> tuple[list, np.ndarray]:
    """Features and tags of the windows that the field is fitted to, and their weights."""
    hashed = docs.where("text IS NOT NULL").select(F.xxhash64("doc_id").alias("h"), "text", F.expr("text RLIKE '[0-9]{4}'").alias("rich"))
    most = {}
    for rich, n in ((True, SAMPLE_DOCS), (False, PLAIN_DOCS)):  # hashes alone are sorted
        most[rich] = hashed.where(F.col("rich") == rich).select("h").orderBy("h").limit(n).agg(F.max("h")).first()[0]
    picked = hashed.where(F.col("h") <= F.when(F.col("rich"), F.lit(most[True])).otherwise(F.lit(most[False]))).select("h", "text")
    ranks = picked.mapInArrow(frugal(_ranks), "rank double").orderBy("rank").limit(SAMPLE_WINDOWS)  # ranks alone are sorted
    least = ranks.agg(F.max("rank")).first()[0]
    found = picked.mapInArrow(frugal(_sampled(1.0 if least is None else least)), "rank double, key long, kind int, tags array<int>, features binary")
    rows = found.orderBy("rank", "key", "kind", "features").limit(3 * SAMPLE_WINDOWS).collect()
    share = rows[-1]["rank"] if sum(r["kind"] < SECRET for r in rows) >= SAMPLE_WINDOWS else 1.0  # of windows chosen
    sample = []
    for r in rows:
        x = np.frombuffer(r["features"], np.int16).reshape(len(r["tags"]), WIDTH)
        sample.append(([f[f < DIMS] for f in x], list(r["tags"])))
    kind = np.array([r["kind"] for r in rows], int)
    weights = np.array([1.0 if k >= SECRET else 1 / max(1e-9, min(1.0, share * (RICH if k == HELD else 1))) for k in kind])
    for some, worth in ((kind < SECRET, REAL), (kind == SECRET, PLANTED), (kind == DECOY, DECOYS)):
        weights[some] *= worth / max(1e-9, weights[some].sum())
    return sample, weights


def trained(docs: DataFrame) -> Field:
    """A field fitted to docs (doc_id, text); see the module's text."""
    field = fitted(*sampled(docs))
    field.emit[BEGIN, _ids(["bias"])] -= MARGIN
    return field


def added_spans(text: str, scores: Scores, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The field's spans that no base span overlaps."""
    if not text or text.isspace():
        return []
    emits, starts, ends = scores.of(text)
    out: list[list[int]] = []
    for first, tags in scores.field.decoded(emits):
        before = OUTSIDE
        for t, tag in enumerate(tags, first):
            if tag == BEGIN or tag == INSIDE and before == OUTSIDE:
                out.append([int(starts[t]), int(ends[t])])
            elif tag == INSIDE:
                out[-1][1] = int(ends[t])
            before = tag
    return [(i, 3, j) for i, j in out if not any(b[0] < j and i < b[2] for b in base)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in spans)


def _scan(field_of):
    def run(batches):
        scores = Scores(field_of.value)
        for b in sliced(batches):
            cols: list[list] = [[] for _ in range(5)]
            for t in b.column(1).to_pylist():
                t = t or ""
                base = base_spans(t)
                every = sorted(base + added_spans(t, scores, base))
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                for c, v in zip(cols, (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def scanned(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(field or trained(docs))  # DIMS * 3 doubles
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        frugal(_scan(shared)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def _redact(field_of, at: int, mark: str):
    def run(batches):
        scores = Scores(field_of.value)
        for b in sliced(batches):
            out = []
            for t in b.column(at).to_pylist():
                if t:
                    base = base_spans(t)
                    parts, end = [], 0
                    for i, _, j in sorted(base + added_spans(t, scores, base)):
                        if i >= end:
                            parts += [t[end:i], mark]
                        end = max(end, j)
                    t = "".join(parts) + t[end:] if parts else t
                out.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, pa.string()), *b.columns[at + 1 :]], b.schema.names)

    return run


def redacted(docs: DataFrame, field: Field | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its texts replaced by mark; overlapping spans become one mark. Other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(field or trained(docs))
    own = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)))
    return own.mapInArrow(frugal(_redact(shared, docs.columns.index("text"), mark)), own.schema).toDF(*docs.columns)
