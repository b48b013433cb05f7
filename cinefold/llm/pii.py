"""Personal data: patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")

# ---- patterns -------------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can start at a run's first digit alone: from a later one it would fail in the same way.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def small(part: str) -> bool:
    """Whether a number of any length is at most 255."""
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the patterns' matches, by kind and start."""
    out: list[tuple[int, int, int]] = []
    at, past = text.find("@"), 0
    while at >= 0:  # every match has one @, after all the local characters that no earlier match took
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            past = m.end()
            out.append((0, start, past))
        at = text.find("@", max(at + 1, past))
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


# ---- word shapes ----------------------------------------------------------------------------------------------------

#: Words with a shape of their own.
_LEXICON = {
    "at": ("at", "arroba", "chez", "klammeraffe"),
    "dot": ("dot", "punkt", "punto", "point"),
    "domain": ("com", "net", "org", "edu", "gov", "info", "biz", "io", "de", "fr", "es", "eu", "uk"),
    "call": ("phone", "tel", "telephone", "telefon", "call", "fax", "mobile", "cell", "whatsapp"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "cc"),
    "mail": ("mail", "email", "contact", "write"),
    "host": ("ip", "host", "server", "address"),
}
_PUNCTUATION = "@.-+():/[]{}_%#,$<>"
_DIGITS = (1, 2, 3, 4, 5, 7, 9, 13, 20)
_CASES = ("lower", "upper", "title", "mixed", "other")
SHAPES = {name: i for i, name in enumerate(["none", *_CASES, *(f"d{n}" for n in _DIGITS), "d3 over", *(f"w {w}" for w in _LEXICON), *_PUNCTUATION])}
TEMPLATES = 7

# Classes of characters; letters are what counts as one inside a word, so numerals like a superscript as well.
_SPACE, _DIGIT_CLASS, _OTHER, _LOWER, _UPPER, _UNCASED, _NUMERAL = range(7)
#: Code points that are looked at one by one; beyond them there are neither letters nor white space.
_KNOWN = 0x32400


@functools.cache
def _classes() -> np.ndarray:
    def of(c: str) -> int:
        if c.isspace():
            return _SPACE
        if c in "0123456789":
            return _DIGIT_CLASS
        if not c.isalnum() or c.isdecimal():
            return _OTHER
        return (_LOWER if c.islower() else _UPPER if c.isupper() else _UNCASED) if c.isalpha() else _NUMERAL

    out = np.full(0x110000, _OTHER, np.uint8)
    out[:_KNOWN] = [of(chr(i)) for i in range(_KNOWN)]
    return out


def _packed(word: str) -> int:
    return functools.reduce(lambda x, c: x * 32 + ord(c) - 96, word, 0)


_LONGEST = max(len(w) for words in _LEXICON.values() for w in words)
_LEXICON_CODES, _LEXICON_SHAPES = map(np.array, zip(*sorted((_packed(w), SHAPES[f"w {name}"]) for name, words in _LEXICON.items() for w in words), strict=True))
_MARKS = np.full(128, SHAPES["other"], np.int64)
_MARKS[[ord(c) for c in _PUNCTUATION]] = [SHAPES[c] for c in _PUNCTUATION]


class Words(NamedTuple):
    """Tokens of some texts in order: text's number, start and end in it, shape, whether space or a text's edge lies before."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    apart: np.ndarray


def words_of(texts: list[str]) -> Words:
    """Tokens are runs of letters, runs of ASCII digits, and other single characters that aren't white space.

    A token's shape is the case of a word, the number of digits, the mark itself, or a word's place in the lexicon. All
    texts are read as one array of code points.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _classes()[codes]
    group = np.minimum(kind, _LOWER)
    new = np.diff(group, prepend=_SPACE) != 0
    alone = group == _OTHER
    start = np.flatnonzero((new | alone) & (group != _SPACE))
    end = np.flatnonzero((np.append(new[1:], True) | alone) & (group != _SPACE)) + 1
    size, of = end - start, group[start]
    shape = np.full(len(start), SHAPES["other"], np.int64)
    marks = np.flatnonzero(of == _OTHER)
    shape[marks] = _MARKS[np.minimum(codes[start[marks]], 127)]
    shape[marks[codes[start[marks]] > 127]] = SHAPES["other"]
    digits = np.flatnonzero(of == _DIGIT_CLASS)
    shape[digits] = SHAPES["d1"] - 1 + np.searchsorted(_DIGITS, size[digits], side="right")
    three = digits[size[digits] == 3]
    value = sum((codes[start[three] + k].astype(np.int64) - 48) * 10 ** (2 - k) for k in range(3))
    shape[three[value > 255]] = SHAPES["d3 over"]

    def within(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flag, dtype=np.int32)))
        return total[end[at]] - total[start[at]]

    words = np.flatnonzero(of == _LOWER)
    low, up, plain = within(kind == _LOWER, words), within(kind == _UPPER, words), within(kind == _NUMERAL, words) == 0
    case = np.full(len(words), SHAPES["mixed"], np.int64)
    case[(up == 0) & (low > 0)] = SHAPES["lower"]
    case[(low == 0) & (up > 0)] = SHAPES["upper"]
    case[(up == 1) & (low > 0) & (kind[start[words]] == _UPPER)] = SHAPES["title"]
    shape[words] = np.where(plain, case, SHAPES["other"])
    letter = np.where((codes | 32) - 97 < 26, (codes | 32) - 96, 0).astype(np.int64)
    short = words[(size[words] > 1) & (size[words] <= _LONGEST)]
    short = short[within(letter == 0, short) == 0]
    code, going = np.zeros(len(short), np.int64), np.arange(len(short))
    for k in range(_LONGEST):
        going = going[size[short[going]] > k]
        code[going] = code[going] * 32 + letter[start[short[going]] + k]
    at = np.minimum(np.searchsorted(_LEXICON_CODES, code), len(_LEXICON_CODES) - 1)
    known = _LEXICON_CODES[at] == code
    shape[short[known]] = _LEXICON_SHAPES[at[known]]
    text = np.searchsorted(first, start, side="right") - 1
    apart = np.ones(len(start), bool)
    apart[1:] = (start[1:] > end[:-1]) | (text[1:] != text[:-1])
    return Words(text, start - first[text], end - first[text], shape, apart)


def _beside(words: Words, step: int) -> np.ndarray:
    """The shapes of the tokens that many places on in the same text; "none" beyond its edges."""
    out, n = np.zeros(len(words.shape), np.int64), abs(step)
    here, there = (slice(None, -n), slice(n, None)) if step > 0 else (slice(n, None), slice(None, -n))
    out[here] = np.where(words.text[here] == words.text[there], words.shape[there], 0)
    return out


def features(words: Words) -> np.ndarray:
    """The numbers of each token's features: shapes at distances to 2, and its own with spaces before and after it."""
    size, after = len(SHAPES), np.append(words.apart[1:], True)
    columns = [words.shape, *(_beside(words, k) for k in (-1, 1, -2, 2)), 2 * words.shape + words.apart, 2 * words.shape + after]
    return np.stack([c + b * size for c, b in zip(columns, (0, 1, 2, 3, 4, 5, 7), strict=True)], axis=1)


N_FEATURES = 9 * len(SHAPES)
#: States: outside, then the beginning and the inside of each kind.
N_STATES = 1 + 2 * len(KINDS)


def _allowed() -> np.ndarray:
    """What may follow: an inside only its own kind's beginning or inside; the last row is a text's start."""
    ok = np.ones((N_STATES + 1, N_STATES), bool)
    for s in range(2, N_STATES, 2):
        ok[:, s] = False
        ok[[s - 1, s], s] = True
    return ok


ALLOWED = _allowed()
#: Stretches that are decoded at a time, and characters of texts that are read at a time.
STRETCHES, CHARACTERS = 1 << 12, 1 << 19

# ---- the labelled table ---------------------------------------------------------------------------------------------


def labelled(rows: int = 600, seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, [(kind's number, start, end)]): a small table of written-out forms, other numbers, and plain words."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ta", "en", "lor", "mi", "sho", "be", "ru", "ing", "ka", "st", "o")) for _ in range(r.randint(1, 4)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    byte = lambda: str(r.randint(0, 255))

    def email() -> str:
        user = r.choice((word(), f"{word()}.{digits(2)}", f"{word()}_{word()}", f"{word()}{digits(3)}"))
        host, top = r.choice((word(), f"{word()}{digits(1)}.{word()}", f"{word()}-{word()}")), r.choice(_LEXICON["domain"])
        at, dot = r.choice((("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", " . "), (" AT ", " DOT ")))
        return f"{user}{at}{host}{dot}{top}"

    def ip() -> str:
        return r.choice((".", ".", "[.]", " . ", "(.)")).join(byte() for _ in range(4))

    def card() -> str:
        sep = r.choice((" ", "-", "", ".", "  "))
        return r.choice((sep.join(digits(4) for _ in range(4)), sep.join((digits(4), digits(6), digits(5)))))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits(2)} {a} {digits(6)}", f"+{digits(2)} {digits(2)} {c} {digits(4)}", f"({a}) {b} {c}", f"+{digits(1)}-{a}-{b}-{c}", f"({a}){b}-{c}"))

    def other() -> str:
        return r.choice((
            f"{digits(2)},{digits(3)}", f"{digits(1)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"v{digits(1)}.{digits(1)}", f"20{digits(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}",
            f"0{r.randint(1, 9)}/{r.randint(10, 28)}/20{digits(2)}", f"{r.randint(10, 23)}:{r.randint(10, 59)}", f"${digits(2)}", f"no {digits(2)}", f"{digits(2)}-{digits(2)}", f"at {word()}", f"{word()} at {digits(1)}",
            f"id {digits(6)}", f"@{word()}", f"@ {digits(1)}", f"{word()}@{word()}", digits(24), digits(8), f"({digits(4)})", f"{word()} ({word()})", f"[{digits(2)}]", f"{word()} dot {word()}", f"page {digits(3)}",
            f"{word()} de {word()}", f"{word()}. De {word()}", f"{word()} de de {word()}.", f"{word()}, es {word()}", f"{r.choice(('chez', 'point', 'punto', 'punkt'))} {word()}", f"{word()}.\n{r.choice(('De', 'Es', 'At'))} {word()}",
            r.choice("%$&*#") * 3, f"{word()}{r.choice('%$&*#') * 3}",
            f"{digits(4)} {digits(4)}", f"{digits(3)} {digits(3)}", "4.0", f"({digits(1)})", f"{word()}.{word()}", f"{digits(2)} {digits(2)} {digits(2)}", f"#{digits(5)}",
        ))

    makers = (email, ip, card, phone)
    hints = ("mail", "host", "card", "call")
    out = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            lead = " ".join(r.choice((word(), word().title(), word() + ",", word().upper())) for _ in range(r.randint(0, 4)))
            kind = r.randrange(8)
            text += lead + " " * bool(lead)
            if kind < 4:
                if r.random() < 0.4:
                    text += r.choice(_LEXICON[hints[kind]]) + r.choice((" ", ": "))
                found = makers[kind]()
                spans.append((kind, len(text), len(text) + len(found)))
                text += found
            else:
                text += other()
            text += r.choice((" ", ". ", ", ", " ", "! ")) + r.choice(("", word() + " ", r.choice(("de ", "es ", "De ", "at ", "$$$ "))))
        out.append((text, spans))
    return out


# ---- the field ------------------------------------------------------------------------------------------------------


def best_states(scores: np.ndarray, moves: np.ndarray, start: np.ndarray, size: np.ndarray, open_: np.ndarray, closed: np.ndarray) -> np.ndarray:
    """The best states of stretches of tokens, (start, size) in the rows of ``scores``, by Viterbi over many at a time.

    ``moves`` has a last row for a text's start, which stretches that are ``open_`` have before them; others follow
    state 0. State 0 follows on stretches that are ``closed``; nothing does on others.
    """
    states = np.zeros(len(scores), np.int8)
    order = np.argsort(-size, kind="stable")
    for k in range(0, len(order), STRETCHES):
        part = order[k : k + STRETCHES]
        at, n = start[part], size[part]
        best = np.where(open_[part, None], moves[-1], moves[0]) + scores[at]
        back: list[np.ndarray] = []
        for t in range(1, int(n[0])):
            on = int(np.searchsorted(-n, -t))
            through = best[:on, :, None] + moves[None, :-1]
            came = through.argmax(axis=1)
            back.append(came.astype(np.int8))
            best[:on] = np.take_along_axis(through, came[:, None], 1)[:, 0] + scores[at[:on] + t]
        last = (best + np.where(closed[part, None], moves[:-1, 0], 0)).argmax(axis=1)
        for t in range(int(n[0]) - 1, -1, -1):
            on = int(np.searchsorted(-n, -t))
            states[at[:on] + t] = last[:on]
            if t:
                last[:on] = back[t - 1][np.arange(on), last[:on]]
    return states


class Field:
    """Weights of features by state, and of transitions (the last row from a text's start)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, np.where(ALLOWED, moves, -1e9)
        n = len(SHAPES)
        w = [weights[b * n : (b + 2 if b > 4 else b + 1) * n] for b in (0, 1, 2, 3, 4, 5, 7)]
        #: Scores by (shape, space before, space after), and by the two shapes to the left and to the right.
        self.own = (w[0][:, None, None] + w[5].reshape(n, 2, 1, -1) + w[6].reshape(n, 1, 2, -1)).reshape(4 * n, -1)
        self.left, self.right = ((w[a][:, None] + w[b][None]).reshape(n * n, -1) for a, b in ((1, 3), (2, 4)))
        m = self.moves
        #: What the transitions of a span gain over state 0 all along: into its beginning and out of each state, at most
        #: over what may stand beside it, from its beginning inside, and from inside on.
        self.into = [max(m[a, k + 1] - m[a, 0] for a in range(N_STATES + 1)) for k in range(0, N_STATES - 1, 2)]
        self.out = [max(0, *(m[s, b] - m[0, b] for b in (0, *range(1, N_STATES, 2)))) for s in range(N_STATES)]
        self.deeper = [(m[k + 1, k + 2] - m[0, 0], m[k + 2, k + 2] - m[0, 0]) for k in range(0, N_STATES - 1, 2)]

    def scores(self, words: Words) -> np.ndarray:
        """(tokens, states): the summed weights of every token's features."""
        n, after = len(SHAPES), np.append(words.apart[1:], True)
        out = self.own[4 * words.shape + 2 * words.apart + after]
        out += self.left[_beside(words, -1) * n + _beside(words, -2)]
        out += self.right[_beside(words, 1) * n + _beside(words, 2)]
        return out

    def outside(self, words: Words, scores: np.ndarray) -> np.ndarray:
        """Tokens that are outside on every best path.

        Replacing a whole span by state 0 changes a path's score by the sum of what its tokens and transitions gain. A
        token can only lie in a span on a best path if some span over it may gain: the best beginning before it, by a
        running maximum over differences of running sums, and the best end after it, by one from behind.
        """
        n, most = len(scores), np.full(len(scores), -np.inf)
        for kind in range(len(KINDS)):
            first, inside = (scores[:, 2 * kind + k] - scores[:, 0] for k in (1, 2))
            enter, stay = self.deeper[kind]
            leave, into = self.out[2 * kind + 2], self.into[kind]
            run = np.cumsum(inside + stay)
            begun = first + (into + enter - stay) - run
            apart = words.text * (np.ptp(run) + np.ptp(begun) + 1)  # keeps the maxima within a text
            ended = np.maximum.accumulate((run - apart)[::-1])[::-1] + apart + leave
            np.maximum(most, first + (into + self.out[2 * kind + 1]), out=most)
            np.maximum(most[1:], np.maximum.accumulate(begun + apart)[:-1] - apart[1:] + ended[1:], out=most[1:])
            last = np.ones(n, bool)
            last[:-1] = words.text[1:] != words.text[:-1]
            np.maximum(most[:-1], np.where(last[:-1], -np.inf, begun[:-1] + ended[1:]), out=most[:-1])
        return most < -1e-3

    def decode(self, words: Words, prune: bool = True) -> np.ndarray:
        """The best states of all tokens of whole texts.

        Tokens that are outside on every best path cut a text into stretches that don't bear on each other; ``prune``
        tells whether to use that, and changes no result.
        """
        states = np.zeros(len(words.text), np.int8)
        if not len(states):
            return states
        scores = self.scores(words)
        free = ~self.outside(words, scores) if prune else np.ones(len(states), bool)
        edge = np.ones(len(states) + 1, bool)
        edge[1:-1] = words.text[1:] != words.text[:-1]
        held = np.concatenate(([False], free, [False]))
        start = np.flatnonzero(free & (edge[:-1] | ~held[:-2]))
        end = np.flatnonzero(free & (edge[1:] | ~held[2:])) + 1
        return best_states(scores, self.moves, start, end - start, edge[start], ~edge[end])


class Sample:
    """A labelled table as arrays: features and true states of all tokens, and where they lie in rows of one length."""

    def __init__(self, table: list[tuple[str, list[tuple[int, int, int]]]]):
        words = words_of([text for text, _ in table])
        self.features, self.truth = features(words), np.zeros(len(words.text), np.int64)
        for row, (_, spans) in enumerate(table):
            for kind, start, end in spans:
                inside = np.flatnonzero((words.text == row) & (words.start >= start) & (words.end <= end))
                self.truth[inside] = 2 + 2 * kind
                self.truth[inside[:1]] = 1 + 2 * kind
        sizes = np.bincount(words.text, minlength=len(table))
        self.mask = np.arange(sizes.max()) < sizes[sizes > 0][:, None]
        starts = np.flatnonzero(np.diff(words.text, prepend=-1))
        self.moves = np.zeros((N_STATES + 1, N_STATES))
        np.add.at(self.moves, (np.full(len(starts), N_STATES), self.truth[starts]), 1)
        inner = np.setdiff1d(np.arange(len(self.truth)), starts)
        np.add.at(self.moves, (self.truth[inner - 1], self.truth[inner]), 1)

    def loss(self, w: np.ndarray, m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The negative log-likelihood per token, and its slopes by ``w`` and ``m``, by scaled forward-backward."""
        moves, mask, total = np.exp(m) * ALLOWED, self.mask, len(self.truth)
        flat = w[self.features].sum(axis=1)
        top = flat.max(axis=1, keepdims=True)
        local = np.ones((*mask.shape, N_STATES))
        local[mask] = np.exp(flat - top)
        ahead, behind = np.zeros_like(local), np.ones_like(local)  # each scaled to a sum of one
        log = top.sum() - flat[np.arange(total), self.truth].sum() - (m * self.moves).sum()
        for t in range(mask.shape[1]):
            new = (ahead[:, t - 1] @ moves[:-1] if t else moves[-1]) * local[:, t]
            scale = new.sum(axis=1, keepdims=True)
            log += np.log(scale[mask[:, t]]).sum()
            ahead[:, t] = new / scale
        by_move = np.zeros_like(m)
        for t in range(mask.shape[1] - 1, 0, -1):
            on = mask[:, t]
            here = local[on, t] * behind[on, t]
            joint = ahead[on, t - 1] / (((ahead[on, t - 1] @ moves[:-1]) * here).sum(axis=1, keepdims=True))
            by_move[:-1] += moves[:-1] * (joint.T @ here)
            new = here @ moves[:-1].T
            behind[on, t - 1] = new / new.sum(axis=1, keepdims=True)
        share = ahead * behind
        share /= share.sum(axis=2, keepdims=True)
        by_move[-1] = share[:, 0].sum(axis=0)
        error = share[mask]
        error[np.arange(total), self.truth] -= 1
        by_weight = np.zeros_like(w)
        for k in range(TEMPLATES):
            for state in range(N_STATES):
                by_weight[:, state] += np.bincount(self.features[:, k], error[:, state], len(w))
        return log / total, by_weight / total, (by_move - self.moves) / total


def train(table: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 150, rate: float = 0.15, penalty: float = 1e-4) -> Field:
    """The field of greatest likelihood, penalised by squares, by Adam over the whole table."""
    sample = Sample(table)
    found = [np.zeros((N_FEATURES, N_STATES)), np.zeros((N_STATES + 1, N_STATES))]
    first, second = ([np.zeros_like(p) for p in found] for _ in range(2))
    for step in range(1, steps + 1):
        for i, slope in enumerate(sample.loss(*found)[1:]):
            g = slope + penalty * found[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            found[i] = found[i] - rate * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Field(*found)


@functools.cache
def production_field() -> Field:
    return train(labelled())


# ---- spans ----------------------------------------------------------------------------------------------------------

def sound(kind: int, text: str) -> bool:
    """Whether a span that the field found can be what it says."""
    if kind == 0:
        plain = re.sub(r"\s*[\[({<]?\s*\b(?:at|AT|arroba)\b\s*[\])}>]?\s*", "@", text) if "@" not in text else text
        plain = re.sub(r"\s*[\[({<]\s*(?:dot|DOT|\.)\s*[\])}>]\s*|\s+(?:dot|DOT)\s+|\s*\.\s*", ".", plain)
        return bool(_EMAIL.fullmatch(plain.replace(" @ ", "@")))
    if kind == 1:
        parts = re.sub(r"[\s\[\](){}]", "", text).split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and small(p) for p in parts)
    digits = "".join(_DIGIT.findall(text))
    if kind == 2:
        return 13 <= len(digits) <= 19 and not set(text) - set("0123456789 .-") and luhn(digits)
    return 10 <= len(digits) <= 15 and len(_DIGIT.findall(text)) < len(text) and not set(text) - set("0123456789 .-()+")


def found_spans(texts: list[str], field: Field, prune: bool = True) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of every text. The field's sound spans join those that overlap no base span."""
    words = words_of(texts)
    states = field.decode(words, prune)
    more: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for t in np.flatnonzero(states % 2 == 1).tolist():
        kind, last, i = int(states[t] - 1) // 2, t, int(words.text[t])
        while last + 1 < len(states) and states[last + 1] == states[t] + 1 and words.text[last + 1] == i:
            last += 1
        start, end = int(words.start[t]), int(words.end[last])
        if sound(kind, texts[i][start:end]):
            more[i].append((kind, start, end))
    out = []
    for text, new in zip(texts, more, strict=True):
        own = base_spans(text)
        if new:
            starts, ends = zip(*sorted((a, b) for _, a, b in own), strict=True) if own else ((), ())
            past = np.maximum.accumulate(np.array([0, *ends]))  # where the first so many base spans end at most
            new = [(kind, a, b) for kind, a, b in new if past[np.searchsorted(starts, b)] <= a]
        out.append((own, sorted(own + new)))
    return out


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, or run of spans that overlap, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for start, kind, end in sorted((a, k, b) for k, a, b in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, some characters at a time, or one text that has more."""
    part, held = [], 0
    for text in texts:
        if part and held + len(text) > CHARACTERS:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def find(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """All rows and columns with n_email, n_ip, n_card, n_phone, base_sha256, spans and masked.

    The numbers and the hash are those of the pattern spans; ``spans`` has them and those that the field adds, and
    ``masked`` is the text with all of them replaced. Null texts count as empty; very long texts are read to their end;
    repeated rows are handled alike; columns named as the added ones are replaced; an empty table gives no rows.
    """
    field = field or production_field()
    small_batches(docs.sparkSession)
    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked string"

    @F.pandas_udf(schema)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, rows = batch.tolist(), []
            for part in _parts(texts):
                for own, (base, every) in zip(part, found_spans(part, field), strict=True):
                    counts = [sum(1 for s in base if s[0] == kind) for kind in range(len(KINDS))]
                    rows.append((*counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(every), masked(own, every) if every else own))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked"])

    out = docs.withColumn("_pii", read(F.coalesce(F.col(text), F.lit(""))))
    return out.withColumns({c: F.col(f"_pii.{c}") for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked")}).drop("_pii")


def redact(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """All rows and columns, with all spans in the text replaced; null texts stay null and n_chars follows the text."""
    out = find(docs.select(*docs.columns), text, field)
    out = out.withColumn(text, F.when(F.col(text).isNotNull(), F.col("masked")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(text).isNotNull(), F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
