"""Secret scans: fixed patterns, and a linear-chain conditional random field over words.

Words are tagged secret begin, inside or outside. A word's score is the sum of weights for its own shape, for
what its neighbours hint at and for its file's; transitions have weights too, and Viterbi finds the best tags.
A word whose best other tag cannot make up for the most that transitions can give is outside in every best
sequence, so only runs of other words need the recursion, and its result is that of the whole text.

Weights are trained by gradient ascent of the likelihood on a bounded sample of passages: some around pattern
spans, some plain. The patterns are no more than a start, as a field that learns only from them finds only
what they find. Each passage is therefore also learnt in other forms (``variants``): with the value alone or
behind another name for it, and with drawn secrets or drawn harmless look-alikes put in.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

KINDS = ("assign", "access", "hex")
#: Letters in either case are ASCII's alone.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What a text must match to hold any pattern span.
ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""

Span = tuple[str, int, int]


def _matches(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of each pattern span; in order of start, then kind."""
    out = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def base_spans(text: str) -> list[Span]:
    """Spans of each kind, leftmost and without overlap within the kind; in order of start, then kind."""
    return [s[:3] for s in _matches(text)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- features -------------------------------------------------------------------------------------------

#: Bits for a word's own shape, for the word before, the one before that, the word behind, a value that is named, and the file.
OWN, BEFORE, EARLIER, BEHIND, NAMED, FILE = 30, 5, 2, 2, 4, 2
#: Parts of words that name a secret, and words that lead from the name to it.
CUES = (b"pass", b"pwd", b"secret", b"token", b"key", b"cred", b"auth", b"bearer", b"kennwort", b"geheim", b"zugang", b"contrase", b"clave", b"secreto", b"jeton", "schlüssel".encode(), "clé".encode())
LINKS = (b"is", b"was", b"=", b":", b"=>", b"->", b":=", b"to", b"are", b"ist", b"lautet", b"est", b"es", b"son", b"equals")
#: A name and a password before a host.
LOGIN = re.compile(rb"://[^:/@]*:([^/@]+)@")


def _class_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(chars)] = 1
    return out


_DIGIT = _class_table(string.digits.encode())
_UPPER = _class_table(string.ascii_uppercase.encode())
_LOWER = _class_table(string.ascii_lowercase.encode())
_VOWEL = _class_table(b"aeiouAEIOU")
_HEXA = _class_table(b"0123456789abcdefABCDEF")
_OPEN = _class_table(b"=:")
_LINK = _class_table(b"_-")
_SLASH = _class_table(b"/")
_DOT = _class_table(b".")
_AT = _class_table(b"@")
_NUMBER = _class_table(b"0123456789.,:+-/()%$#")
_LEAD = _class_table(b"\"'(<[{`")
_TRAIL = _class_table(b"\"'()<>[]{}`,;.:!?%$#&*|=")


@dataclass
class Coded:
    """Feature codes of the words of some texts: bits of the shape, of what a word hints at, and of the file; each word's value is [low, high)."""

    own: np.ndarray
    hint: np.ndarray
    file: np.ndarray  # of each text
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _holding(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, wanted: tuple[bytes, ...]) -> np.ndarray:
    """Which words hold one of the wanted parts."""
    out = np.zeros(len(starts), bool)
    for part in wanted:
        at = np.flatnonzero(folded[: max(len(folded) - len(part) + 1, 0)] == part[0])
        for i, c in enumerate(part[1:], 1):
            at = at[folded[at + i] == c]
        own = np.searchsorted(starts, at, side="right") - 1
        out[own[at + len(part) <= ends[own]]] = True  # a match may run on into the next text
    return out


def _values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word what is behind its last = or :, without the quotes, brackets and marks around it."""
    trail, opened = _TRAIL[data] > 0, _OPEN[data] > 0
    place = np.arange(len(data))
    last = np.maximum.accumulate(np.where(trail, -1, place))[ends - 1]  # the last character that is no mark
    high = np.where(last >= starts, last + 1, starts)
    behind = np.maximum.accumulate(np.where(opened, place, -1))[np.maximum(high - 1, starts)] + 1
    low = np.where((behind > starts) & (behind < high), behind, starts)
    head = np.minimum.accumulate(np.where(_LEAD[data] > 0, len(data), place)[::-1])[::-1]
    low = np.minimum(head[np.minimum(low, len(data) - 1)], high)
    return low, high


def code(data: np.ndarray, offsets: np.ndarray) -> Coded:
    starts, ends, first = words.bounds(data, offsets)
    n_texts = len(offsets) - 1
    if not len(starts):
        z = np.zeros(0, np.int64)
        return Coded(z, z, np.zeros(n_texts, np.int64), z, z, first, z, z)
    low, high = _values(data, starts, ends)
    folded = words.LOWER[data]
    login = np.zeros(len(starts), bool)
    for i in np.flatnonzero(_holding(folded, starts, ends, (b"://",))).tolist():
        if m := LOGIN.search(data[starts[i] : ends[i]].tobytes()):
            login[i], low[i], high[i] = True, starts[i] + m.start(1), starts[i] + m.end(1)
    size = high - low

    def count(table: np.ndarray) -> np.ndarray:
        upto = np.concatenate([np.zeros(1, np.int32), np.cumsum(table[data], dtype=np.int32)])
        return upto[high] - upto[low]

    def turns(changes: np.ndarray) -> np.ndarray:
        upto = np.concatenate([np.zeros(2, np.int32), np.cumsum(changes, dtype=np.int32)])
        return upto[high] - upto[np.minimum(low + 1, high)]

    digit, upper, lower, hexa, link, slash, dot, at, vowel, number = map(count, (_DIGIT, _UPPER, _LOWER, _HEXA, _LINK, _SLASH, _DOT, _AT, _VOWEL, _NUMBER))
    seen = size
    letter = upper + lower
    is_digit, is_upper, is_lower = _DIGIT[data] > 0, _UPPER[data] > 0, _LOWER[data] > 0
    mixes = turns(is_digit[1:] != is_digit[:-1])
    humps = turns(is_lower[:-1] & is_upper[1:])
    cue = _holding(folded, starts, ends, CUES)
    slashes = np.concatenate([np.zeros(1, np.int32), np.cumsum(_SLASH[data], dtype=np.int32)])
    in_path = ((slashes[low] - slashes[starts] > 0) | (slash > 0) & (dot > 0)) & ~login
    tail = lambda k: data[np.maximum(high - k, 0)]
    year = (size > 4) & is_digit[np.maximum(high - 1, 0)] & is_digit[np.maximum(high - 2, 0)] & ((tail(4) == 0x31) & (tail(3) == 0x39) | (tail(4) == 0x32) & (tail(3) == 0x30))
    prefixed = low > starts
    plain = digit + letter + link + slash + dot + at
    bits = [
        digit > 0, upper > 1, (upper > 0) & (lower > 0) & (digit > 0), plain + 2 < seen, size >= 6, size >= 8, size >= 12, size >= 16,
        size >= 20, size >= 32, prefixed, prefixed & cue, (digit > 0) & (letter > 0), mixes >= 2, mixes >= 4, (hexa == seen) & (size >= 16),
        (number == seen) & (seen > 0), at > 0, slash > 1, link > 0, dot >= 2, (letter >= 6) & (vowel * 6 < letter), humps >= 2, digit * 5 >= seen,
        login, in_path, year, (link == 4) & (size == 36) & (hexa + link == seen), (link >= 2) & (letter > 0) & (letter + digit + link == seen), (digit == seen) & (size >= 5) & (size <= 12),
    ]
    own = sum(b.astype(np.int64) << i for i, b in enumerate(bits))
    length = ends - starts
    short = np.flatnonzero(length <= 7)
    leads = np.zeros(len(starts), bool)
    keys = {int.from_bytes(x, "big") for x in LINKS}
    packed = np.zeros(len(short), np.int64)
    for i in range(7):
        has = length[short] > i
        packed[has] = packed[has] * 256 + folded[starts[short[has]] + i]
    leads[short] = np.isin(packed, list(keys))
    ends_open = _OPEN[data[ends - 1]] > 0
    hint = sum(b.astype(np.int64) << i for i, b in enumerate((cue & ~(size >= 32), ends_open, leads, digit > 0, size >= 32)))
    n = np.maximum(np.diff(first), 1)
    in_text = lambda x: (lambda s: s[first[1:]] - s[first[:-1]])(np.concatenate([[0], np.cumsum(x)]))
    file = (in_text(digit > 0) * 20 >= n).astype(np.int64) | ((in_text(prefixed) * 20 >= n).astype(np.int64) << 1)
    return Coded(own, hint, file, starts, ends, first, low, high)


def shifted(x: Coded, by: int) -> np.ndarray:
    """Hints of the word ``by`` places on in the same text, 0 where there is none."""
    n = len(x.hint)
    out = np.zeros(n, np.int64)
    text = np.repeat(np.arange(len(x.first) - 1), np.diff(x.first))
    at = np.arange(n) + by
    ok = (at >= 0) & (at < n)
    ok[ok] = text[at[ok]] == text[ok]
    out[ok] = x.hint[at[ok]]
    return out


def _bits(values: np.ndarray, n: int) -> np.ndarray:
    return (values[:, None] >> np.arange(n)) & 1


def parts(x: Coded) -> list[tuple[np.ndarray, int]]:
    """The feature codes of each word with their number of bits, in the order of the weights."""
    behind = shifted(x, 1)
    behind = (behind & 1) | ((behind >> 3) & 2)  # names a secret, is long
    before, earlier = shifted(x, -1), shifted(x, -2)
    named = (before & 1) | ((before >> 1 | before >> 2) & earlier & 1)  # a name just before, or one that leads here
    mixed, phrase, number = (x.own >> 12) & 1, (x.own >> 28) & 1, (x.own >> 29) & 1
    file = np.repeat(x.file, np.diff(x.first))
    conjoined = named & mixed | (named & ~mixed) << 1 | (named & phrase) << 2 | (named & number) << 3
    return [(x.own & 4095, 12), (x.own >> 12 & 4095, 12), (x.own >> 24, OWN - 24), (before, BEFORE), (earlier & 3, EARLIER), (behind, BEHIND), (conjoined, NAMED), (file, FILE)]


# --- the field ------------------------------------------------------------------------------------------

TAGS = 3  # outside, begin, inside
N_FEATURES = 1 + OWN + BEFORE + EARLIER + BEHIND + NAMED + FILE


@dataclass
class Field:
    weights: np.ndarray  # features x tags
    move: np.ndarray  # tags x tags

    def scores(self, x: Coded) -> np.ndarray:
        """Scores of each word's tags: of each part of its code, what a table of all its values says."""
        e = np.repeat(self.weights[:1], len(x.own), axis=0)
        at = 1
        for values, n in parts(x) if len(x.own) else ():
            e += (_bits(np.arange(1 << n), n) @ self.weights[at : at + n])[values]
            at += n
        return e


def viterbi(e: np.ndarray, move: np.ndarray, before: int | None, behind: int | None) -> list[int]:
    """The best tags of a run, given the tags beside it (None: the text begins or ends there)."""
    v = e[0] + (move[before] if before is not None else 0)
    back = []
    for x in e[1:]:
        s = v[:, None] + move
        back.append(s.argmax(axis=0))
        v = s.max(axis=0) + x
    if behind is not None:
        v = v + move[:, behind]
    tags = [int(v.argmax())]
    for b in back[::-1]:
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def decode(x: Coded, field: Field) -> dict[int, int]:
    """Words that are not outside, with their tags; the same as Viterbi over every whole text."""
    e = field.scores(x)
    m = field.move
    lead = (e[:, 1:] - e[:, :1]).max(axis=1, initial=-np.inf)
    # a word is outside in every best sequence if no neighbours' transitions can make up for its score
    gain = (m[:, 1:] - m[:, :1]).max() + (m[1:] - m[:1]).max()
    open_ = np.flatnonzero(lead + max(gain, 0) >= 0)
    out: dict[int, int] = {}
    if not len(open_):
        return out
    # and so is a run of others, if no word of it gains by the best transition into a secret from outside or within one
    into = np.full(len(e), max(m[0, 1:].max(), m[1:, 1:].max()) - m[0, 0])
    into[x.first[:-1][np.diff(x.first) > 0]] = 0  # nothing leads into a text's first word
    worth = lead + into + max(m[1:, 0].max() - m[0, 0], 0) >= 0
    text = np.searchsorted(x.first, open_, side="right") - 1
    breaks = np.flatnonzero((np.diff(open_) > 1) | (np.diff(text) > 0)) + 1
    edges = np.concatenate([[0], breaks, [len(open_)]])
    some = np.concatenate([[0], np.cumsum(worth[open_])])
    for k in np.flatnonzero(some[edges[1:]] > some[edges[:-1]]):
        a, b, t = int(open_[edges[k]]), int(open_[edges[k + 1] - 1]) + 1, text[edges[k]]
        tags = viterbi(e[a:b], m, 0 if a > x.first[t] else None, 0 if b < x.first[t + 1] else None)
        out.update({a + i: tag for i, tag in enumerate(tags) if tag})
    return out


def expected(e: np.ndarray, move: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each word's tags and expected numbers of moves; words by their place in the passages, the longest passages first."""
    edges = np.concatenate([[0], np.cumsum(live)]).tolist()
    m, w = np.exp(move), np.exp(e - e.max(axis=1, keepdims=True))
    a, b, pairs = np.empty_like(w), np.ones_like(w), np.zeros_like(move)
    for t, (s, end) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if t:
            before = edges[t - 1]
            w[s:end] *= 1 / ((x := (a[before : before + end - s] @ m) * w[s:end]).sum(axis=1, keepdims=True))
            a[s:end] = x / x.sum(axis=1, keepdims=True)
        else:
            a[:end] = w[:end] / w[:end].sum(axis=1, keepdims=True)
    for t in range(len(live) - 1, 0, -1):
        s, end, before = edges[t], edges[t + 1], edges[t - 1]
        x = w[s:end] * b[s:end]
        pairs += a[before : before + end - s].T @ x
        b[before : before + end - s] = x @ m.T
    return a * b, pairs * m


def fit(features: np.ndarray, tags: np.ndarray, length: np.ndarray, steps: int = 150, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """From the words of passages of these lengths, one passage after the other, by adaptive gradient steps from zero."""
    n = len(length)
    order = np.argsort(-length, kind="stable")
    first = np.cumsum(length) - length
    live = (length[order] > np.arange(length.max())[:, None]).sum(axis=1)
    place = np.concatenate([first[order[:k]] + t for t, k in enumerate(live)])
    kinds, own = np.unique(features[place], axis=0, return_inverse=True)  # many words look alike
    tags = tags[place]
    by_kind = lambda p: np.stack([np.bincount(own, p[:, i], len(kinds)) for i in range(TAGS)], axis=1)
    inner = np.flatnonzero(np.arange(len(place)) >= live[0])
    before = inner - np.repeat(live[:-1], live[1:])
    seen_w = kinds.T @ by_kind(np.eye(TAGS)[tags]) / n
    seen_m = np.bincount(tags[before] * TAGS + tags[inner], minlength=TAGS * TAGS).reshape(TAGS, TAGS) / n
    w, move = np.zeros((features.shape[1], TAGS)), np.zeros((TAGS, TAGS))
    gw, gm = np.full_like(w, 1e-6), np.full_like(move, 1e-6)
    for _ in range(steps):
        p, pairs = expected((kinds @ w)[own], move, live)
        dw = seen_w - kinds.T @ by_kind(p) / n - decay * w
        dm = seen_m - pairs / n - decay * move
        gw += dw**2
        gm += dm**2
        w += rate * dw / np.sqrt(gw)
        move += rate * dm / np.sqrt(gm)
    return Field(w, move)


# --- training sample ------------------------------------------------------------------------------------

#: Passages of each sort in the training sample, their words, the characters of a word, and documents that may give those with spans.
SAMPLE, PASSAGE, WORD, LOOKED_AT = 500, 24, 400, 200_000
SEED = 11

#: A passage: its words, and whether each begins a secret (1), goes on with it (2) or is outside (0).
Passage = tuple[list[str], list[int]]

NAMES = ("password", "Password", "passwd", "pwd", "pass", "passphrase", "secret", "SECRET_KEY", "client_secret", "token", "access_token", "AUTH_TOKEN", "api_key", "apikey", "API_KEY", "auth_key", "AUTH_KEY", "private_key", "access_key", "credentials", "DB_PASSWORD", "db_pwd", "Bearer", "key", "Passwort", "Kennwort", "mot de passe", "contraseña", "clave", "passcode", "Zugangscode")
#: How a name leads to its value; a space parts words.
LEADS = ("{n}={v}", "{n}:{v}", "{n}: {v}", "{n} = {v}", '{n} = "{v}"', "{n}='{v}'", '"{n}": "{v}",', "{n} {v}", "{n} is {v}", "{n} was {v}.", "{n} => {v}", "{n} ist {v}", "{n} est {v}", "{n} es {v}", "{n} lautet {v}.", "{v}", "{v}", "({v})", '"{v}"')
#: Addresses that tell a password.
LOGINS = ("https://{u}:{v}@{h}/", "ftp://{u}:{v}@{h}", "redis://:{v}@{h}:6379", "mysql://{u}:{v}@{h}/{u}", "DSN={u}://{u}:{v}@{h}/{u}")


def _draw(rng: random.Random, letters: str, low: int, high: int) -> str:
    return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))


def drawn_secret(rng: random.Random, least: int = 0) -> tuple[str, bool]:
    """A value, and whether it needs a name beside it to be told from a usual word, as those from 5 on."""
    sign = string.ascii_letters + string.digits
    kind = rng.randrange(least, 9)
    if kind == 0:
        return _draw(rng, "0123456789abcdef", 16, 64), False
    if kind == 1:
        return _draw(rng, sign, 18, 44), False
    if kind == 2:
        return _draw(rng, sign + "+/", 24, 64) + rng.choice(("", "=", "==")), False
    if kind == 3:  # letters, what it is for, and a value
        return rng.choice(("_", "-")).join([_draw(rng, string.ascii_lowercase, 2, 5), *([_draw(rng, string.ascii_lowercase, 3, 5)] if rng.random() < 0.6 else []), _draw(rng, sign, 16, 40)]), False
    if kind == 4:  # three encoded parts
        return "ey" + ".".join(_draw(rng, sign + "_-", k, 3 * k) for k in (14, 20, 24)), False
    if kind == 5:  # a word and digits
        return _draw(rng, string.ascii_lowercase, 3, 8).capitalize()[rng.randrange(2) :] + _draw(rng, string.digits, 1, 4) + rng.choice(("", "", "!", "#x", "$A")), True
    if kind == 6:  # words with a sign between them
        return rng.choice("-_").join(_draw(rng, string.ascii_lowercase, 3, 8) for _ in range(rng.randint(3, 5))) + rng.choice(("", _draw(rng, string.digits, 1, 3))), True
    if kind == 7:
        return _draw(rng, string.digits, 6, 9), True
    return _draw(rng, sign + "!@#$%^&*", 8, 16) + rng.choice(string.digits), True


def drawn_login(rng: random.Random) -> tuple[str, str]:
    """An address with a name and a password, and the password."""
    value = _draw(rng, string.ascii_letters + string.digits + "!$%-_", 8, 20)
    word = lambda: _draw(rng, string.ascii_lowercase, 3, 8)
    return rng.choice(LOGINS).format(u=word(), v=value, h=f"{word()}.{word()}.com"), value


def drawn_harmless(rng: random.Random) -> str:
    """What looks a little like a secret and is none: numbers, addresses, dates, names of files and things."""
    low, d = string.ascii_lowercase, string.digits
    word = lambda: _draw(rng, low, 3, 9)
    uuid = lambda: "-".join(_draw(rng, "0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12))
    forms = (
        lambda: f"{word()}.{_draw(rng, d, 1, 2)}@{word()}{_draw(rng, d, 0, 1)}.example.com",
        lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        lambda: _draw(rng, d, 16, 16),
        lambda: f"+{_draw(rng, d, 1, 2)} ({_draw(rng, d, 3, 3)}) {_draw(rng, d, 3, 3)}-{_draw(rng, d, 4, 4)}",
        lambda: f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}",
        lambda: f"https://www.{word()}.com/{word()}/{word()}{_draw(rng, d, 0, 3)}",
        lambda: f"{word()}_{word()}.{rng.choice(('pdf', 'txt', 'py', 'csv'))}",
        lambda: f"/{word()}/{word()}/{word()}{_draw(rng, d, 0, 2)}",
        lambda: word().capitalize() + word().capitalize() + word().capitalize(),
        lambda: f"{word()}-{word()}-{word()}",
        lambda: f"{_draw(rng, string.ascii_uppercase, 2, 4)}-{_draw(rng, d, 3, 6)}",
        lambda: f"v{rng.randrange(9)}.{rng.randrange(30)}.{rng.randrange(9)}",
        lambda: f"{rng.randrange(10**6):,}.{rng.randrange(100):02d}",
        lambda: f"{word()}{_draw(rng, d, 1, 2)}",
        lambda: _draw(rng, low, 12, 24),
        lambda: _draw(rng, string.ascii_uppercase, 6, 20) + "!!",
        lambda: f"{rng.choice(NAMES)} {word()}",
        lambda: f"the {rng.choice(NAMES).lower()} is {word()}",
        lambda: f"{word()}={word()}",
        lambda: f"{word()}: {word()}",
        lambda: f"{word()} {uuid()} {word()}",
        lambda: f"{word()}={uuid()}",
        lambda: f"https://www.{word()}.com/{word()}?{rng.choice('abcpqv')}={_draw(rng, string.ascii_letters + d + '-_', 8, 14)}",
        lambda: f"{word()}.com/{_draw(rng, string.ascii_letters + d, 8, 14)}",
        lambda: f"{rng.choice(NAMES)} {word()} {word().capitalize()}{rng.randrange(1950, 2040)}",
        lambda: f"{rng.choice(NAMES)} {word()} {_draw(rng, d, 1, 4)} {word()}",
        lambda: f"{rng.choice(NAMES)} {word()} {word()} {word()}-{word()}-{word()}",
        lambda: f"{rng.choice(NAMES)}: {word()} {word()} {_draw(rng, d, 5, 8)}",
        lambda: f"{word()} {rng.choice(LINKS).decode()} {_draw(rng, d, 4, 10)}",
        lambda: f"{word()} {rng.choice(LINKS).decode()} {word().capitalize()}{_draw(rng, d, 1, 4)}",
        lambda: f"{_draw(rng, d, 3, 3)}-{_draw(rng, d, 1, 1)}-{_draw(rng, d, 2, 4)}-{_draw(rng, d, 5, 6)}-{_draw(rng, d, 1, 1)}",
        lambda: f"{_draw(rng, '0123456789abcdef', 7, 10)}",
        lambda: f"{_draw(rng, string.ascii_uppercase, 2, 3)}-{rng.randrange(1990, 2040)}-{_draw(rng, d, 3, 6)}",
        lambda: f"{word().capitalize()}{rng.randrange(1950, 2040)}",
    )
    return forms[rng.randrange(len(forms))]()


def _put(passage: Passage, at: int, text: str, value: str | None) -> Passage:
    """The passage with words more; the one that holds the value is a secret."""
    more = text.split(" ")
    tags = [1 if value is not None and value in w else 0 for w in more]
    return passage[0][:at] + more + passage[0][at:], passage[1][:at] + tags + passage[1][at:]


def _named(rng: random.Random, value: str, needs_name: bool) -> str:
    lead = rng.choice([x for x in LEADS if not needs_name or "{n}" in x])
    name = rng.choice(NAMES)
    if rng.random() < 0.3:
        name = "_".join([_draw(rng, string.ascii_lowercase, 2, 6), name])
    return lead.format(n=rng.choice((name, name.upper())), v=value)


def key_block(rng: random.Random) -> str:
    """An encoded key over several lines: one secret of several words."""
    return " ".join([_draw(rng, string.ascii_letters + string.digits + "+/", 64, 64) for _ in range(rng.randint(2, 4))] + [_draw(rng, string.ascii_letters + string.digits, 20, 60) + "="])


def variants(passages: list[tuple[bool, Passage]], rng: random.Random) -> Iterator[Passage]:
    """The forms in which passages are learnt: as they are, with a span's value otherwise named, and with secrets and harmless things put in."""
    for held, passage in passages:
        yield passage
        text, tags = passage
        if held:
            at = tags.index(1) if 1 in tags else -1
            if at >= 0:  # without the name before it, and behind another
                value = re.split("[=:]", text[at].strip("\"',;.!?="))[-1].strip("\"'") or text[at]
                low = max(at - 2, 0) if re.search("(?i)pass|secret|token|key", " ".join(text[max(at - 2, 0) : at])) else at
                for new in (value, _named(rng, value, False)):
                    yield _put((text[:low] + text[at + 1 :], tags[:low] + tags[at + 1 :]), low, new, value)
            continue
        value, needs_name = drawn_secret(rng)
        yield _put(passage, rng.randrange(len(text) + 1), _named(rng, value, needs_name), value)
        value = drawn_secret(rng, least=5)[0]
        yield _put(passage, rng.randrange(len(text) + 1), rng.choice(NAMES) + rng.choice((" ", " is ", ": ")) + value, value)
        if rng.random() < 0.3:
            address, value = drawn_login(rng)
            yield _put(passage, rng.randrange(len(text) + 1), address, value)
        more = _put(passage, rng.randrange(len(text) + 1), drawn_harmless(rng), None)
        for _ in range(2):
            more = _put(more, rng.randrange(len(more[0]) + 1), drawn_harmless(rng), None)
        yield _put(more, rng.randrange(len(more[0]) + 1), drawn_harmless(rng), None)
        if rng.random() < 0.1:
            at, block = rng.randrange(len(text) + 1), key_block(rng).split(" ")
            yield text[:at] + block + text[at:], tags[:at] + [1] + [2] * (len(block) - 1) + tags[at:]


def _holders(column: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(column.fill_null(""), ANY).to_numpy(zero_copy_only=False)


def _around_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _passages(b.filter(pa.array(_holders(b.column(1)))) for b in batches)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sort, draw, words, tags) of one passage a text: around a drawn span of it, or at a drawn place."""
    for batch in common.slices(batches):
        column = batch.column(1)
        holds = _holders(column)
        rows = []
        for d, draw in enumerate(batch.column(0).to_pylist()):
            text = column[d].as_py() or ""
            spans = [(a, b, v) for _, a, b, v in _matches(text)] if holds[d] else []
            rng = random.Random(draw)
            middle = spans[rng.randrange(len(spans))][2] if spans else rng.randrange(len(text) + 1)
            room = PASSAGE * 60  # characters that surely hold the words beside the middle, or a long word that is cut
            low, high = max(0, middle - room), min(len(text), middle + room)
            found = list(re.finditer("[^\x20\x09-\x0d]+", text[low:high]))
            if not found:
                continue
            at = next((i for i, m in enumerate(found) if low + m.end() > middle), len(found) - 1)
            near = found[max(0, at - PASSAGE // 2) : at + PASSAGE // 2]
            tags = [0] * len(near)
            for a, b, value in spans:
                for i, m in enumerate(near):
                    if low + m.start() < b and low + m.end() > value:
                        tags[i] = 1 if tags[i] or low + m.start() <= value else 2
            rows.append((bool(spans), d, [m.group()[:WORD] for m in near], tags))
        if rows:
            sort, d, text, tag = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(sort), batch.column(0).take(pa.array(d)), pa.array(text, pa.list_(pa.string())), pa.array(tag, pa.list_(pa.int32()))], names=["sort", "draw", "words", "tags"])


def learn(passages: list[tuple[bool, Passage]]) -> Field:
    """A field from passages as ``variants`` gives them; without any, everything is outside."""
    forms = [(w, t) for w, t in variants(passages, random.Random(SEED)) if w]
    if not forms:
        w = np.zeros((N_FEATURES, TAGS))
        w[0] = (100.0, 0.0, 0.0)
        return Field(w, np.zeros((TAGS, TAGS)))
    raw = [" ".join(w).encode() for w, _ in forms]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    x = code(np.frombuffer(b"".join(raw), np.uint8), offsets)
    features = np.concatenate([np.ones((len(x.own), 1)), *(_bits(v, n) for v, n in parts(x))], axis=1)
    return fit(features, np.concatenate([np.array(t) for _, t in forms]), np.diff(x.first))


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field trained on ``sample`` passages with spans and ``sample`` without at most, those of least hash of text and doc_id."""
    schema = "sort boolean, draw long, words array<string>, tags array<int>"
    n = max(docs.count(), 1)
    whole = float(1 << 40)
    drawn = docs.select(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 40)).alias("draw"), "text")
    held = drawn.where(F.col("draw") < whole * min(1.0, LOOKED_AT / n)).mapInArrow(_around_spans, schema).where("sort")
    plain = drawn.where(F.col("draw") < whole * min(1.0, 2 * sample / n)).mapInArrow(_passages, schema).where("not sort")
    rows = [r for part in (held, plain) for r in part.orderBy("draw", "words").limit(sample).collect()]
    return learn([(r["sort"], (r["words"], r["tags"])) for r in rows])


# --- the scan -------------------------------------------------------------------------------------------

#: Characters that a value of the field's own has at least.
LEAST = 6
#: Marks that belong to a value which they end.
ENDING = b"!#$%&*="


def _field_spans(x: Coded, data: np.ndarray, tags: dict[int, int], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Bytes of a text's tagged values that no pattern span touches; ``tags`` are its own, in order of words, ``taken`` is sorted. Marks that end a password are part of it."""
    out, last = [], -2
    for i, tag in tags.items():
        high = int(x.high[i])
        while high < x.ends[i] and data[high] in ENDING:
            high += 1
        if tag == 2 and last == i - 1 and out:
            out[-1] = (out[-1][0], high)
        else:
            out.append((int(x.low[i]), high))
        last = i
    starts = np.array([p for p, _ in taken], np.int64)
    far = np.maximum.accumulate(np.array([q for _, q in taken], np.int64)) if taken else starts
    clear = lambda a, b: (k := int(np.searchsorted(starts, b))) == 0 or far[k - 1] <= a
    return [(a, b) for a, b in out if b - a >= LEAST and clear(a, b)]


def scanner(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = field.value
        empty = hashlib.sha256(b"").hexdigest()
        for batch in common.slices(batches):
            column = batch.column(1)
            n = batch.num_rows
            data, offsets = common.utf8(column)
            x = code(data, offsets)
            tagged: dict[int, dict[int, int]] = {}
            for i, tag in sorted(decode(x, f).items()):
                tagged.setdefault(int(np.searchsorted(x.first, i, side="right")) - 1, {})[i] = tag
            counts = np.zeros((3, n), np.int64)
            digest, spans = [empty] * n, [""] * n
            for d in sorted({*np.flatnonzero(_holders(column)).tolist(), *tagged}):
                found = base_spans(column[d].as_py() or "")
                for k, _, _ in found:
                    counts[KINDS.index(k), d] += 1
                base = joined(found)
                if d in tagged:
                    zero = int(offsets[d])
                    begins = (data[zero : int(offsets[d + 1])] & 0xC0) != 0x80  # bytes that begin a code point
                    byte = np.append(np.flatnonzero(begins), len(begins))
                    taken = [(zero + int(byte[a]), zero + int(byte[b])) for _, a, b in found]
                    point = lambda b: int(np.searchsorted(byte, b - zero))  # noqa: B023, E731
                    found = sorted(found + [("field", point(a), point(b)) for a, b in _field_spans(x, data, tagged[d], taken)], key=lambda s: (s[1], (*KINDS, "field").index(s[0])))
                digest[d], spans[d] = hashlib.sha256(base.encode()).hexdigest(), joined(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts), pa.array(digest), pa.array(spans)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; spans of kind ``field`` are the field's own.

    Places are code points, ends exclusive. A null or empty text has no span. Null doc_ids and repeated rows
    are scanned each by itself. Without a text nothing is learnt and nothing found but the patterns. An empty
    table gives an empty result; other columns are not read.
    """
    common.bound_batches(docs.sparkSession)
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    field = docs.sparkSession.sparkContext.broadcast(train(doc, sample))
    return doc.mapInArrow(scanner(field), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))
