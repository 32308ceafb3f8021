"""Personal information in free text: a skip-chain conditional random field that labels every token of every text.

Its features come from the text alone: the class and the identity of a token and of its neighbours, form and affixes, and whether the
corpus writes a word in lower case. Chains join neighbours; skip edges join distant tokens of a text that are one word or one slip
apart, and loopy max-product passes their labels along. Precise cues (``pii_cues``) label the bounded sample that the field is fitted to; half of the
given names are hidden from the features of half of that sample, so that form and context carry names that no list has."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .lexicon import GIVEN_NAMES, SHORT_FORMS, TITLES
from .names import one_edit
from .pii_cues import luhn, spans
from .quality import COMMON_WORDS

KINDS = ("name", "email", "phone", "id_number", "address")
LABELS = ("none", *KINDS)
#: Texts that cues look at for the field to be fitted to, a bound, and which of those without cues are taken; frequent everyday words that are sent to every task, a bound; all other such words are joined.
SAMPLE, WITHOUT, KNOWN = 12_000, 8, 60_000
#: Rounds of message passing over skip edges.
ROUNDS = 5
#: Tokens on either side whose class and identity a token's potentials see each by itself, and beyond them as one sum.
NEAR, FAR = 4, 10

_GIVENS = GIVEN_NAMES | frozenset(SHORT_FORMS)
#: Months and days; words that end, start or are the tail of a street's name; at and dot spelt out.
_MONTHS = frozenset("january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split())
_STREET_END = frozenset("st rd ave ln dr ct cl blvd street road lane close drive crescent cres way court terrace avenue place gardens grove row square sq boulevard walk mews hill park rise view green quay".split())
_STREET_START = frozenset("rue avenue boulevard bd place chemin impasse allée allee quai route cours passage calle avenida avda plaza paseo camino carrer via viale piazza am im an zum zur auf".split())
_STREET_TAIL = tuple("straße strasse weg allee platz gasse hof ring damm ufer wiek wijk straat laan gracht kade plein dijk singel steeg pad".split())
_AT_DOT = frozenset("at dot arroba ät punkt punto point punt".split())

_PARTS = (
    r"[^\W\d_]+(?:['’\-][^\W\d_]+)*(?!{after}|-\d)",  # a word
    r"(?=[A-Za-z]{{1,5}}-?\d|\d+-?[A-Za-z]\b)(?<![\w])[A-Za-z]{{0,5}}-?\d[\dA-Za-z]*(?:-[\dA-Za-z]+)*\b",  # letters with digits
    r"(?:\+ ?|\()?\d+(?:(?:[ .\-/\n]|\) ?|\)-| ?\(|-\()\d+)*",  # groups of digits
    r"[^\W\d_]+(?:['’\-][^\W\d_]+)*",
    r"\n\s*",
    r"[^\w\s]|_",
)
_MAIL = r"[\w.+'\-]*\w@\w[\w\-]*(?:-\n\w+)?(?:\.\n?\w[\w\-]*)+"
#: A token with the white space before it, so that tokens end to end are the text. The look ahead for mail addresses is dear, so only texts with their sign have it.
_TOKEN = re.compile(r"[^\S\n]*(?:" + "|".join([_PARTS[0].format(after=r"[\w@+]|[.\-'][\w.\-]*@"), _MAIL, *(p.format() for p in _PARTS[1:])]) + ")")
_TOKEN_BARE = re.compile(r"[^\S\n]*(?:" + "|".join(p.format(after=r"\w") for p in _PARTS) + ")")


def tokens_of(text: str) -> list[str]:
    """The tokens of a text, each with the white space before it."""
    return (_TOKEN if "@" in text else _TOKEN_BARE).findall(text)


_BEFORE = re.compile(r"^[^\S\n]+")


def kind_of(token: str) -> str:
    """What kind of token one without white space before it is: line, mail, word, number, code or sign."""
    if token[0] == "\n":
        return "line"
    if "@" in token and len(token) > 1:
        return "mail"
    if any(map(str.isalpha, token)):
        return "code" if any(map(str.isdecimal, token)) else "word"
    return "number" if any(map(str.isdecimal, token)) else "word" if token[0].isalnum() else "sign"


_CASES = ("lower", "capital", "upper", "mixed")
_WORDS = ("title", "given", "month", "street_end", "street_start", "street_tail", "at_dot", "common", "everyday", "unknown")
_CLASSES = (
    ["pad", "mail", "line", "blank", "initial", "letter"]
    + [f"{w}_{c}" for w in _WORDS for c in _CASES]
    + [f"digits_{n}" for n in ("1", "2", "3", "4", "5_7", "8_9", "10_13", "14_19", "more")]
    + [f"{f}_{m}" for f in ("plus", "zeros", "zero", "parts", "spaced") for m in ("short", "mid", "long")]
    + ["ssn", "us_phone", "card", "decimal"]
    + ["code_nino", "code_licence", "code_passport", "code_letter_end", "code_house", "code_other"]
    + [f"sign_{s}" for s in ".,:;()[]{}<>-–—@/'\"#&*|=_+$€£%!?…•"]
    + ["sign_other"]
)
CLASS = {name: k for k, name in enumerate(_CLASSES)}
#: Sizes of the tables of affixes and of class triples, to which they are hashed.
_AFFIXES, _TRIPLES = 1024, 1 << 16


def number_class(run: str) -> str:
    """The class of a run of digit groups by its form alone."""
    digits = re.sub(r"\D", "", run)
    n, plain = len(digits), re.sub(r"\s", " ", run)
    size = "short" if n < 9 else "mid" if n < 13 else "long"
    if re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", plain):
        return "ssn"
    if re.fullmatch(r"\(?\d{3}\)?[ .\-]{1,2}\d{3}[ .\-]\d{4}", plain):
        return "us_phone"
    if plain[0] == "+":
        return f"plus_{size}"
    if n >= 13 and luhn(digits):
        return "card"
    if re.fullmatch(r"\d+\.\d{1,2}", plain):
        return "decimal"
    if digits.startswith("00"):
        return f"zeros_{size}"
    if digits[0] == "0" and n >= 6:
        return f"zero_{size}"
    if not plain.isdigit() and n >= 6:
        return f"{'spaced' if ' ' in plain else 'parts'}_{size}"
    return f"digits_{n if n < 5 else '5_7' if n < 8 else '8_9' if n < 10 else '10_13' if n < 14 else '14_19' if n < 20 else 'more'}"


def code_class(run: str) -> str:
    """The class of letters with digits by their form alone."""
    if re.fullmatch(r"(?i)[A-Z]{2}-?\d{2}-?\d{2}-?\d{2}-?[A-D]", run):
        return "code_nino"
    if re.fullmatch(r"[A-Z]{5}\d{6}[A-Z0-9]{2,5}", run):
        return "code_licence"
    if re.fullmatch(r"(?i)[A-Z]{1,2}\d{7,8}", run):
        return "code_passport"
    if re.fullmatch(r"(?i)[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]", run):
        return "code_letter_end"
    return "code_house" if re.fullmatch(r"\d{1,4}[A-Za-z]", run) else "code_other"


def word_class(word: str, everyday: bool, hidden: bool = False) -> str:
    """The class of a word: what lists and the corpus say of it, and its case. ``hidden`` leaves out the list of given names."""
    low = word.lower()
    if len(word) == 1:
        return "initial" if word.isupper() else "letter"
    case = "lower" if word.islower() else "upper" if word.isupper() else "capital" if word[0].isupper() else "mixed"
    kind = (
        "title" if low in TITLES else "given" if low in _GIVENS and not hidden else "month" if low in _MONTHS else "street_end" if low in _STREET_END
        else "street_start" if low in _STREET_START else "at_dot" if low in _AT_DOT else "common" if low in COMMON_WORDS else "street_tail" if len(low) > 5 and low.endswith(_STREET_TAIL) and not everyday
        else "everyday" if everyday else "unknown"
    )
    return f"{kind}_{case}"


@dataclass
class Tokens:
    """Tokens of many texts end to end, ``FAR`` pads before and after each: types, classes, places, touching neighbours, and which text each is of.

    A type is a class, a word's identity and an affix; ``kinds`` has them by type."""

    type: np.ndarray
    cls: np.ndarray
    glue: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    kinds: np.ndarray


class Reader:
    """Cuts texts into tokens; what is known of a token string is looked up once and kept."""

    def __init__(self, frequent: frozenset[str], vocabulary: dict[str, int]) -> None:
        self.frequent, self.vocabulary = frequent, vocabulary
        self.kept: dict[str, int] = {}  # twice the type, and one more for white space before it
        self.types: dict[tuple[int, int, int], int] = {(0, 0, 0): 0}

    def look(self, token: str, kind: str, everyday: bool = False, hidden: bool = False) -> int:
        word = affix = 0
        if kind == "word":
            low = token.lower()
            name = word_class(token, everyday or low in self.frequent, hidden)
            affix = crc32(low[-3:].encode()) % (_AFFIXES - 1) + 1 if name.startswith("unknown") else 0
            word = self.vocabulary.get(low, 0)
        elif kind == "number":
            name = number_class(token)
        elif kind == "line":
            name = "blank" if token.count("\n") > 1 else "line"
        else:
            name = "mail" if kind == "mail" else code_class(token) if kind == "code" else f"sign_{token}"
        key = (CLASS.get(name, CLASS["sign_other"]), word, affix)
        return self.types.setdefault(key, len(self.types))

    def read(self, texts: list[str], rare: list, hide: list[int] | None = None) -> Tokens:
        """``rare`` has a text's everyday words that are not among the frequent ones; ``hide`` has the half (0 or 1) of the given names hidden from a text."""
        types: list[int] = []
        sizes: list[int] = []
        lengths = []
        kept = self.kept
        if len(kept) > 400_000:
            kept.clear()
        blank = [0] * FAR
        for number, text in enumerate(texts):
            words = tokens_of(text)
            own = list(map(kept.get, words))
            if None in own:
                for k, value in enumerate(own):
                    if value is None:
                        bare = _BEFORE.sub("", words[k])
                        own[k] = 2 * self.look(bare, kind_of(bare)) + (bare != words[k])
                        if len(words[k]) <= 64:
                            kept[words[k]] = own[k]
            if rare[number] or hide is not None:
                known = frozenset(rare[number] or ())
                for k, word in enumerate(words):
                    low = word.strip().lower()
                    if low in known or (hide is not None and low in _GIVENS and crc32(low.encode()) % 2 == hide[number]):
                        own[k] = 2 * self.look(word.strip(), "word", low in known, low in _GIVENS) + own[k] % 2
            types += blank
            types += own
            types += blank
            sizes += blank
            sizes += map(len, words)
            sizes += blank
            lengths.append(len(own) + 2 * FAR)
        coded = np.array(types, np.int32)
        kind, apart = coded >> 1, coded & 1
        kinds = np.array(list(self.types), np.int32).reshape(-1, 3)
        cls = kinds[kind, 0]
        real = cls > 0
        touch = np.zeros(len(cls), np.int32)
        if len(cls) > 1:
            touching = (apart[1:] == 0) & real[1:] & real[:-1]
            touch[1:] += touching
            touch[:-1] += 2 * touching
        total = np.r_[0, np.cumsum(np.array(sizes, np.int64))]
        owner = np.repeat(np.arange(len(texts)), lengths)
        first = total[np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)] if len(texts) else np.zeros(0, np.int64)
        return Tokens(kind, cls, touch, total[:-1] - first[owner], total[1:] - first[owner], owner, kinds)

    @staticmethod
    def piece(t: Tokens, texts: list[str], k: int) -> tuple[int, int]:
        """Where the token at place k stands in its text, without the white space before it."""
        text, start, end = texts[t.text[k]], int(t.start[k]), int(t.end[k])
        return end - len(_BEFORE.sub("", text[start:end])), end


#: Tables that a token type looks up by itself, by the place of the token it is seen from.
_PLACES = tuple(range(-NEAR, NEAR + 1))
_PAIRS = ("glue", "left", "right", "skip", "middle", "before", "after")


def pair_indices(t: Tokens, rows: np.ndarray | slice) -> dict[str, np.ndarray]:
    """For the tables of a token with its neighbours, the entry that each of ``rows`` looks up."""
    n = len(_CLASSES)
    c = t.cls.astype(np.int32)
    by = lambda k: np.roll(c, -k)[rows]  # noqa: E731  (pads stand at both ends)
    p, o, f, pp, ff = by(-1), by(0), by(1), by(-2), by(2)
    mix = lambda a, b, d: (a * 7919 + b * 1046 + d * 12_997) % _TRIPLES
    return {"glue": o * 4 + t.glue[rows], "left": p * n + o, "right": o * n + f, "skip": p * n + f, "middle": mix(p, o, f), "before": mix(pp, p, o + 211), "after": mix(o, f, ff + 431)}


def table_sizes(words: int) -> dict[str, int]:
    n = len(_CLASSES)
    sizes = {f"class{k:+d}": n for k in _PLACES} | {f"word{k:+d}": words for k in _PLACES} | {f"affix{k:+d}": _AFFIXES for k in (-1, 0, 1)}
    return sizes | {"glue": 4 * n, "left": n * n, "right": n * n, "skip": n * n, "middle": _TRIPLES, "before": _TRIPLES, "after": _TRIPLES, "far_left": words, "far_right": words}


def packed(starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Tokens of runs step by step: entry k has the k-th tokens of the runs that are so long, the longest run first."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    if not len(lengths):
        return []
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    return [starts[:a] + k for k, a in enumerate(active)]


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true entries."""
    edge = np.diff(np.r_[False, mask, False].astype(np.int8))
    starts = np.flatnonzero(edge == 1)
    return starts, np.flatnonzero(edge == -1) - starts


class SkipChainField:
    """Log-linear weights: tables of unary potentials, a chain and a skip potential (label x label)."""

    def __init__(self, tables: dict[str, np.ndarray], chain: np.ndarray, skip: np.ndarray) -> None:
        self.tables, self.chain, self.skip = tables, chain, skip
        self._by_type: dict[object, np.ndarray] = {}

    def by_type(self, kinds: np.ndarray, place: object) -> np.ndarray:
        """The potentials that a token type adds to the token from which it is seen at ``place``; kept until new types come."""
        kept = self._by_type.get(place)
        if kept is None or len(kept) != len(kinds):
            if isinstance(place, str):
                kept = self.tables[place][kinds[:, 1]]
            else:
                kept = self.tables[f"class{place:+d}"][kinds[:, 0]] + self.tables[f"word{place:+d}"][kinds[:, 1]]
                if abs(place) <= 1:
                    kept = kept + self.tables[f"affix{place:+d}"][kinds[:, 2]]
            self._by_type[place] = kept
        return kept

    def unary(self, t: Tokens) -> np.ndarray:
        score = np.zeros((len(t.type), len(LABELS)), np.float32)
        for k in _PLACES:
            own = self.by_type(t.kinds, k)[t.type]
            if k > 0:
                score[:-k] += own[k:]
            elif k < 0:
                score[-k:] += own[:k]
            else:
                score += own
        for name, entry in pair_indices(t, slice(None)).items():
            score += self.tables[name][entry]
        for name, sign in (("far_left", -1), ("far_right", 1)):
            total = np.cumsum(self.by_type(t.kinds, name)[t.type], axis=0, dtype=np.float64)
            if len(total) > 2 * FAR + 1:  # the sum over the places NEAR + 1 to FAR away
                middle = (total[FAR - NEAR :] - total[: NEAR - FAR]).astype(np.float32)  # row r: tokens r + 1 to r + FAR - NEAR
                if sign < 0:
                    score[FAR + 1 :] += middle[: len(score) - FAR - 1]
                else:
                    score[: len(middle) - NEAR] += middle[NEAR:]
        return score

    def beliefs(self, local: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
        """Max-marginals of chains by max-product, forwards and backwards through all runs at once."""
        forward, backward = np.zeros_like(local), np.zeros_like(local)
        for last, here in zip(steps, steps[1:]):
            prev = last[: len(here)]
            best = ((local[prev] + forward[prev])[:, :, None] + self.chain).max(1)
            forward[here] = best - best.max(1, keepdims=True)
        for last, here in zip(reversed(steps[:-1]), reversed(steps)):
            prev = last[: len(here)]
            best = ((local[here] + backward[here])[:, None, :] + self.chain).max(2)
            backward[prev] = best - best.max(1, keepdims=True)
        return local + forward + backward

    def label(self, unary: np.ndarray, edges: np.ndarray, steps: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
        """The most likely label of each token by loopy max-product over chains and skip edges (rows of two tokens)."""
        belief = self.beliefs(unary, steps)
        if not len(edges):
            return belief.argmax(1)
        ends = np.vstack([edges, edges[:, ::-1]])  # a message in each direction
        back = np.roll(np.arange(len(ends)), len(edges))
        sent = np.zeros((len(ends), unary.shape[1]), np.float32)
        for _ in range(rounds):
            out = ((belief[ends[:, 0]] - sent[back])[:, :, None] + self.skip).max(1)
            sent = 0.5 * sent + 0.5 * (out - out.max(1, keepdims=True))
            local = unary.copy()
            np.add.at(local, ends[:, 1], sent)
            belief = self.beliefs(local, steps)
        return belief.argmax(1)

    def islands(self, unary: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Potentials with what certain neighbours add, and the chains of tokens whose label is open.

        A token whose label can only be none, whatever its neighbours' labels, parts the chain; that is exact where no skip edge is."""
        swing = 2 * float(self.chain.max() - self.chain.min()) + 1e-3
        open_ = real & (unary[:, 0] - unary[:, 1:].max(1) <= swing)
        starts, lengths = runs_of(open_)
        local = unary.copy()
        ends = starts + lengths
        before = starts[real[starts - 1]]
        local[before] += self.chain[0]
        after = ends[real[np.minimum(ends, len(real) - 1)]] - 1
        local[after] += self.chain[:, 0]
        return local, packed(starts, lengths)

    @staticmethod
    def fit(t: Tokens, labels: np.ndarray, edges: np.ndarray, words: int, passes: int = 24, batches: int = 12, rate: float = 0.12, decay: float = 1e-7, keep: float = 0.5, scale: float = 0.8, segment: int = 24, thin: int = 4, tilt: float = 1.0) -> SkipChainField:
        """Maximum likelihood of chains over segments of texts, by stochastic gradient ascent with forward-backward sums, then of the skip potential given the chains' posteriors.

        Of segments without personal information one in ``thin`` is taken, with ``tilt`` times that weight."""
        y = len(LABELS)
        tables = {name: np.zeros((size, y), np.float32) for name, size in table_sizes(words).items()}
        field = SkipChainField(tables, np.zeros((y, y), np.float32), np.zeros((y, y), np.float32))
        starts, lengths = runs_of(t.cls > 0)
        if not len(starts):
            return field
        pieces = [(a + k, min(segment, n - k)) for a, n in zip(starts.tolist(), lengths.tolist()) for k in range(0, n, segment)]
        starts, lengths = np.array([a for a, _ in pieces]), np.array([n for _, n in pieces])
        total = np.r_[0, np.cumsum(labels > 0)]
        has = total[starts + lengths] > total[starts]
        thin = thin if (~has).sum() > 2000 else 1
        rng = np.random.default_rng(3)
        chosen = np.flatnonzero(has | (rng.random(len(starts)) < 1 / thin))
        rng.shuffle(chosen)
        parts = [_Batch(t, labels, starts[c], lengths[c], np.where(has[c], 1.0, float(thin) * tilt)) for c in np.array_split(chosen, min(batches, len(chosen)))]
        mean, square = ({name: np.zeros_like(table) for name, table in tables.items()} for _ in range(2))
        chain_mean, chain_square = np.zeros((y, y)), np.zeros((y, y))
        updates = passes * len(parts)
        for number in range(1, updates + 1):
            part = parts[number % len(parts)]
            # tables are left out by chance, so that each learns to do without the others, and a token's own form with strange neighbours
            used = {name for name in tables if rng.random() < keep}
            miss, pairs = part.gradient(field, used)
            slow = rate * min(1.0, 1.5 * (updates - number + 1) / updates)
            fix = np.sqrt(1 - 0.99**number) / (1 - 0.8**number)
            for name, (order, entries, at) in part.grouped.items():
                if name not in used:
                    continue
                step = np.add.reduceat(miss[order], at, axis=0) - decay * tables[name][entries]
                m, v = 0.8 * mean[name][entries] + 0.2 * step, 0.99 * square[name][entries] + 0.01 * step**2
                mean[name][entries], square[name][entries] = m, v
                tables[name][entries] += slow * fix * m / (np.sqrt(v) + 1e-6)
            step = pairs - decay * field.chain
            chain_mean, chain_square = 0.8 * chain_mean + 0.2 * step, 0.99 * chain_square + 0.01 * step**2
            field.chain = (field.chain + slow * fix * chain_mean / (np.sqrt(chain_square) + 1e-6)).astype(np.float32)
        for table in tables.values():
            table *= scale
        field.skip = field._fit_skip(t, labels, edges)
        return field

    def _fit_skip(self, t: Tokens, labels: np.ndarray, edges: np.ndarray, rounds: int = 200, worth: float = 50.0) -> np.ndarray:
        """The skip potential by pseudo-likelihood: an end's label given the other end's, where the chains leave it open.

        Few texts of a sample say a name twice, so there is a prior, worth ``worth`` ends: names agree by what it takes to find a name's repeat
        where it stands in the place of half the sample's other name-like words, but by less than what it takes to make names of two such words."""
        y = len(LABELS)
        belief = self.beliefs(self.unary(t), packed(*runs_of(t.cls > 0)))
        alone = np.isin(t.cls, list(_NAMELIKE)) & (labels == 0)
        margin = belief[alone, 0] - belief[alone, 1]
        prior = np.zeros((y, y))
        low, middle = (max(0.0, float(np.quantile(margin, q))) if len(margin) else 1.0 for q in (0.02, 0.5))
        prior[1, 1] = min(1 + 1.1 * middle, 1.4 * low)
        if not len(edges):
            return prior.astype(np.float32)
        skip = prior.copy()
        both = np.vstack([edges, edges[:, ::-1]])
        known = belief[both[:, 0]] - belief[both[:, 0]].max(1, keepdims=True)
        mine, other = labels[both[:, 0]], labels[both[:, 1]]
        truth = np.eye(y)[mine]
        for _ in range(rounds):
            score = known + skip[other]
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            step = np.stack([np.bincount(other, (truth - p)[:, k], y) for k in range(y)], axis=1) - worth * (skip - prior) / 25
            skip += 0.5 / max(1.0, len(both) / 8) * (step + step.T) / 2
        return skip.astype(np.float32)


class _Batch:
    """Segments of labelled texts with the entries that their tokens look up, and the gradient of their likelihood."""

    def __init__(self, t: Tokens, labels: np.ndarray, starts: np.ndarray, lengths: np.ndarray, weight: np.ndarray) -> None:
        rows = np.concatenate([np.arange(a, a + n) for a, n in zip(starts, lengths)])
        self.heavy = np.repeat(weight / (weight * lengths).sum(), lengths).astype(np.float32)[:, None]
        self.steps = packed(np.r_[0, np.cumsum(lengths)[:-1]], lengths)
        own, y = labels[rows], len(LABELS)
        self.truth = np.eye(y, dtype=np.float32)[own]
        self.index = pair_indices(t, rows)
        for k in _PLACES:
            kind = t.kinds[t.type[rows + k]]
            self.index[f"class{k:+d}"], self.index[f"word{k:+d}"] = kind[:, 0], kind[:, 1]
            if abs(k) <= 1:
                self.index[f"affix{k:+d}"] = kind[:, 2]
        self.far = {name: t.kinds[t.type[rows[:, None] + np.array([sign * k for k in range(NEAR + 1, FAR + 1)])], 1] for name, sign in (("far_left", -1), ("far_right", 1))}
        self.grouped = {}
        for name, entry in (self.index | {n: e.ravel() for n, e in self.far.items()}).items():
            order = np.argsort(entry, kind="stable")
            entries, at = np.unique(entry[order], return_index=True)
            self.grouped[name] = (order // (1 if name in self.index else FAR - NEAR), entries, at)
        self.pairs = np.zeros((y, y))
        for last, here in zip(self.steps, self.steps[1:]):
            np.add.at(self.pairs, (own[last[: len(here)]], own[here]), self.heavy[here, 0])

    def gradient(self, field: SkipChainField, used: set[str]) -> tuple[np.ndarray, np.ndarray]:
        """Truth less expectation, of each token's labels and of pairs of neighbours' labels."""
        score = np.zeros_like(self.truth)
        for name, entry in self.index.items():
            if name in used:
                score += field.tables[name][entry]
        for name, entry in self.far.items():
            if name in used:
                score += field.tables[name][entry].sum(1)
        local = np.exp(score - score.max(1, keepdims=True))
        moves = np.exp(field.chain)
        forward, backward = local / local.sum(1, keepdims=True), np.ones_like(local)
        for last, here in zip(self.steps, self.steps[1:]):
            f = (forward[last[: len(here)]] @ moves) * local[here]
            forward[here] = f / f.sum(1, keepdims=True)
        expected = np.zeros_like(self.pairs)
        for last, here in zip(reversed(self.steps[:-1]), reversed(self.steps)):
            prev = last[: len(here)]
            after = local[here] * backward[here]
            b = after @ moves.T
            expected += (forward[prev] * (self.heavy[here, 0] / (forward[prev] * b).sum(1))[:, None]).T @ after * moves
            backward[prev] = b / b.sum(1, keepdims=True)
        p = forward * backward
        return (self.truth - p / p.sum(1, keepdims=True)) * self.heavy, self.pairs - expected


_NAMELIKE = frozenset(CLASS[f"unknown_{c}"] for c in _CASES if c != "lower")


def skip_edges(words: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """Pairs of distant places of one word, or of two one slip apart: each with the one before it that is like it.

    Words one slip apart share a form with at most one letter left out, by which they are found; of several the first seen counts."""
    last: dict[str, int] = {}
    order: dict[str, int] = {}
    near: dict[str, list[str]] = {}
    edges = []
    for k, word in words:
        low = word.lower()
        other = last.get(low)
        if other is None:
            forms = {low, *(low[:i] + low[i + 1 :] for i in range(len(low)))} if len(low) > 4 else {low}
            if len(low) > 4:
                like = min((t for form in forms for t in near.get(form, ()) if one_edit(t, low)), key=order.get, default=None)
                other = None if like is None else last[like]
            order[low] = len(order)
            for form in forms:
                near.setdefault(form, []).append(low)
        if other is not None and k - other > 1:
            edges.append((other, k))
        last[low] = k
    return edges


def edges_of(t: Tokens, texts: list[str], among: np.ndarray | None = None) -> np.ndarray:
    """Skip edges of name-like words, of all texts or those whose numbers are ``among``."""
    likely = np.isin(t.cls, list(_NAMELIKE))
    if among is not None:
        likely &= np.isin(t.text, among)
    places = np.flatnonzero(likely)
    found: list[tuple[int, int]] = []
    for part in np.split(places, np.flatnonzero(np.diff(t.text[places])) + 1) if len(places) else ():
        if len(part) > 1:
            text = texts[t.text[part[0]]]
            found += skip_edges([(int(k), text[t.start[k] : t.end[k]].strip()) for k in part])
    return np.array(found, np.int64).reshape(-1, 2)


def silver_labels(t: Tokens, texts: list[str], found: list[list[tuple[int, int, str]]]) -> np.ndarray:
    """Labels by cues: of overlapping spans the first kind of e-mail, number, address and name. A family name that stands alone elsewhere in a text is a name there too."""
    out = np.zeros(len(t.cls), np.int64)
    edges = np.searchsorted(t.text, np.arange(len(texts) + 1))
    for number, own in enumerate(found):
        if not own:
            continue
        a, z = edges[number], edges[number + 1]
        real = np.arange(a, z)[t.cls[a:z] > 0]
        starts = np.array([Reader.piece(t, texts, k)[0] if t.cls[k] else 0 for k in range(a, z)])
        for kind in ("name", "address", "phone", "id_number", "email"):
            for s, e, k in own:
                if k == kind:
                    out[real[(starts[real - a] < e) & (t.end[real] > s)]] = LABELS.index(kind)
        said = lambda k: texts[number][t.start[k] : t.end[k]].strip().lower()
        family = {said(k) for k in real if out[k] == 1 and t.cls[k] in _NAMELIKE}
        for k in real:
            if family and out[k] == 0 and t.cls[k] in _NAMELIKE and said(k) in family:
                out[k] = 1
    return out


_LETTERS = re.compile(r"[^\W\d_]+")


def plausible(piece: str, kind: str) -> bool:
    """An exact check of what the field found: a name has two words, a phone and an id number enough digits and no card's check digit, an address a number and a word."""
    digits = re.sub(r"\D", "", piece)
    if kind == "name":
        return len(_LETTERS.findall(piece)) >= 2
    if kind == "email":
        return "@" in piece or len(_LETTERS.findall(piece)) >= 4
    if kind == "address":
        return bool(digits) and bool(_LETTERS.search(piece))
    return len(digits) >= 6 and not (13 <= len(digits) <= 19 and kind == "id_number" and luhn(digits)) and (kind == "id_number" or 7 <= len(digits) <= 15)


def entities(texts: list[str], rare: list, reader: Reader, field: SkipChainField) -> list[list[tuple[int, int, str]]]:
    """``(start, end, kind)`` of personal information in each text: runs of one label. A name alone counts where the text has it in full."""
    t = reader.read(texts, rare)
    unary, real = field.unary(t), t.cls > 0
    local, steps = field.islands(unary, real)
    some = np.concatenate(steps) if steps else np.zeros(0, np.int64)
    labels = np.zeros(len(t.cls), np.int64)
    labels[some] = field.beliefs(local, steps)[some].argmax(1)
    # skip potentials only draw towards kinds, so only texts of which an edge has an end with one have a use for messages
    hot = np.unique(t.text[(labels > 0) & np.isin(t.cls, list(_NAMELIKE))])
    edges = edges_of(t, texts, hot) if len(hot) else np.zeros((0, 2), np.int64)
    if len(edges):
        ready = np.unique(t.text[edges[(labels[edges] > 0).any(1), 0]])
        touched = np.flatnonzero(real & np.isin(t.text, ready))
        edges = np.searchsorted(touched, edges[np.isin(t.text[edges[:, 0]], ready)])
        if len(edges):
            apart = np.r_[True, np.diff(t.text[touched]) > 0]
            starts = np.flatnonzero(apart)
            labels[touched] = field.label(unary[touched], edges, packed(starts, np.diff(np.r_[starts, len(touched)])))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    places = np.flatnonzero(labels)
    cuts = np.flatnonzero((np.diff(places) > 1) | (np.diff(labels[places]) != 0)) + 1 if len(places) else []
    ends = (CLASS["line"], CLASS["blank"], CLASS["sign_,"], CLASS["sign_;"], CLASS["sign_:"])
    for run in np.split(places, cuts) if len(places) else ():
        while len(run) and t.cls[run[-1]] in ends:
            run = run[:-1]
        while len(run) and t.cls[run[0]] in ends:
            run = run[1:]
        if len(run):
            out[int(t.text[run[0]])].append((Reader.piece(t, texts, run[0])[0], int(t.end[run[-1]]), LABELS[labels[run[0]]]))
    for number, own in enumerate(out):
        text = texts[number]
        whole = {w.lower() for a, z, k in own if k == "name" and plausible(text[a:z], k) for w in _LETTERS.findall(text[a:z])}
        out[number] = [(a, z, k) for a, z, k in own if plausible(text[a:z], k) or (k == "name" and any(one_edit(w, text[a:z].lower()) for w in whole if len(w) > 2))]
    return out


def _count_case(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()

    def stated() -> pa.RecordBatch:
        low: dict[str, list[int]] = {}
        for word, n in words.items():
            low.setdefault(word.lower(), [0, 0])[0 if word.islower() else 1] += n
        return pa.record_batch([pa.array(list(low), pa.string()), pa.array([v[0] for v in low.values()], pa.int64()), pa.array([v[1] for v in low.values()], pa.int64())], ["word", "n_low", "n_cap"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            words.update(set(_LETTERS.findall(text)))
        if len(words) > 1_000_000:
            yield stated()
            words.clear()
    yield stated()


def everyday_words(texts: DataFrame) -> tuple[frozenset[str], DataFrame | None]:
    """Words that texts write in lower case, what no family name is: the ``KNOWN`` most frequent, and a column ``word`` of all others, None if there are none."""
    counts = texts.select("text").mapInArrow(_count_case, "word string, n_low long, n_cap long").groupBy("word").agg(F.sum("n_low").alias("n_low"), F.sum("n_cap").alias("n_cap"))
    words = cut(counts.filter("n_low >= 3 and n_low * 2 >= n_cap").select("word", "n_low"))
    rows = words.coalesce(32).orderBy(F.desc("n_low"), "word").limit(KNOWN + 1).collect()
    if len(rows) <= KNOWN:
        return frozenset(r["word"] for r in rows), None
    frequent, first = rows[:KNOWN], rows[KNOWN]
    beyond = (F.col("n_low") < first["n_low"]) | ((F.col("n_low") == first["n_low"]) & (F.col("word") >= first["word"]))
    return frozenset(r["word"] for r in frequent), words.filter(beyond).select("word")


def with_rare_words(texts: DataFrame, frequent: frozenset[str], rare: DataFrame | None) -> DataFrame:
    """Texts with ``rare_words``, the everyday words in them beyond the frequent ones, by joins on the word and on the text's hash."""
    if rare is None:
        return texts.withColumn("rare_words", F.lit(None).cast("array<string>"))
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words = [], []
            for key, text in zip(batch.column("_key").to_pylist(), batch.column("text").to_pylist()):
                low = {w.strip().lower() for w in (*_LETTERS.findall(text), *tokens_of(text)) if w.strip()[:1].isalpha()}
                asked = [w for w in low if w not in shared.value and w not in COMMON_WORDS]
                keys += [key] * len(asked)
                words += asked
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array(words, pa.string())], ["_key", "word"])

    keyed = texts.withColumn("_key", F.sha2("text", 256))
    asked = keyed.select("_key", "text").mapInArrow(run, "_key string, word string")
    own = asked.join(rare, "word").groupBy("_key").agg(F.collect_set("word").alias("rare_words"))
    return cut(keyed.join(own, "_key", "left").drop("_key"))


def texts_of(chunks: DataFrame, quarantine: DataFrame) -> DataFrame:
    """``place, row_key, text``: one row per chunk and per quarantine reason that has text."""
    a = chunks.select(F.lit("chunks").alias("place"), F.col("chunk_id").alias("row_key"), "text")
    b = quarantine.select(F.lit("quarantine").alias("place"), F.col("id").cast("string").alias("row_key"), F.col("reason").alias("text"))
    return a.unionByName(b).filter(F.col("text").rlike(r"\S") & F.col("row_key").isNotNull())


class _Either:
    """The frequent everyday words with a text's own rarer ones, without a copy of the former."""

    def __init__(self, frequent: frozenset[str], rare: list[str] | None) -> None:
        self.frequent, self.rare = frequent, frozenset(rare or ())

    def __contains__(self, word: str) -> bool:
        return word in self.frequent or word in self.rare


_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def _cue(shared):
    """The spans that cues find in each text, and one in ``WITHOUT`` texts without any; for the sample that the field is fitted to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start": a, "end": z, "kind": k} for a, z, k in spans(text, _Either(shared.value, own))] for text, own in zip(batch.column("text").to_pylist(), batch.column("rare_words").to_pylist())]
            taken = pa.array([k for k, (x, own) in enumerate(zip(batch.column("text").to_pylist(), found)) if own or crc32(x.encode()) % WITHOUT == 0], pa.int64())
            yield pa.record_batch([batch.column("text").take(taken), batch.column("rare_words").take(taken), pa.array(found, _FOUND).take(taken)], ["text", "rare_words", "found"])

    return run


def fit_sample(texts: list[str], rare: list, found: list[list[tuple[int, int, str]]], frequent: frozenset[str]) -> tuple[dict[str, int], SkipChainField]:
    """The vocabulary and the field of labelled texts. Words of a fifth of a thousandth of the texts, three at least, have weights of their own."""
    seen: Counter = Counter()
    for text in texts:
        seen.update({w for token in tokens_of(text) if (w := token.strip().lower()) and kind_of(w) == "word"})
    least = max(3, len(texts) // 5000)
    words = sorted(w for w, n in seen.items() if n >= least and w not in _GIVENS)
    vocabulary = {w: k + 1 for k, w in enumerate(words)}
    reader = Reader(frequent, vocabulary)
    t = reader.read(texts, rare, [crc32(x.encode()) // WITHOUT % 3 for x in texts])  # 0 and 1 hide a half of the given names, 2 none
    labels = silver_labels(t, texts, found)
    return vocabulary, SkipChainField.fit(t, labels, edges_of(t, texts), len(vocabulary) + 1)


def fit_field(texts: DataFrame, frequent: frozenset[str], sample: int = SAMPLE) -> tuple[dict[str, int], SkipChainField]:
    """The field fitted to texts with ``rare_words``, of about ``sample`` chosen by the hash of their keys, never more than twice as many."""
    share = min(1.0, sample / max(1, texts.select("place").count()))
    # chosen by key, so that the same texts are chosen on every run; the limit only keeps the bound where chance goes beyond it
    some = texts.filter(F.pmod(F.xxhash64("place", "row_key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text", "rare_words")
    shared = texts.sparkSession.sparkContext.broadcast(frequent)
    rows = some.mapInArrow(_cue(shared), "text string, rare_words array<string>, found array<struct<start:int,end:int,kind:string>>").limit(2 * sample).collect()
    rows = sorted({r["text"]: r for r in rows}.values(), key=lambda r: r["text"])
    return fit_sample([r["text"] for r in rows], [r["rare_words"] for r in rows], [[(e["start"], e["end"], e["kind"]) for e in r["found"]] for r in rows], frequent)


#: Characters of text whose tokens are labelled together; a longer text is labelled whole.
_TOGETHER = 1_500_000


def find_personal(texts: DataFrame) -> DataFrame:
    """``place, row_key, text, entities`` of texts with personal information; entities are ``(start, end, kind)`` in characters.

    Repeated and late rows of a key give equal rows; null and blank texts give none; texts of any length are labelled whole."""
    frequent, rare = everyday_words(texts)
    texts = with_rare_words(texts, frequent, rare)
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((frequent, *fit_field(texts, frequent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, vocabulary, field = shared.value
        reader = Reader(frequent, vocabulary)
        for batch in batches:
            every, own = batch.column("text").to_pylist(), batch.column("rare_words").to_pylist()
            group = np.cumsum([len(x) for x in every]) // _TOGETHER if every else np.zeros(0, int)
            rows, out = [], []
            for part in np.split(np.arange(len(every)), np.flatnonzero(np.diff(group)) + 1):
                for k, hits in zip(part, entities([every[i] for i in part], [own[i] for i in part], reader, field)):
                    if hits:
                        rows.append(int(k))
                        out.append([{"start": a, "end": z, "kind": c} for a, z, c in hits])
            kept = batch.select(["place", "row_key", "text"]).take(pa.array(rows, pa.int64()))
            yield pa.record_batch([*kept.columns, pa.array(out, _FOUND)], ["place", "row_key", "text", "entities"])

    return texts.mapInArrow(run, "place string, row_key string, text string, entities array<struct<start:int,end:int,kind:string>>")


def personal_kinds(texts: DataFrame) -> DataFrame:
    """``place, row_key, kind``: one row per text and kind of personal information in it."""
    return find_personal(texts).select("place", "row_key", F.explode("entities.kind").alias("kind")).distinct()


def mask_text(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each piece replaced by ``[KIND]``."""
    out, at = [], 0
    for a, z, kind in sorted(found):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = z
    return "".join([*out, text[at:]])


def redact(texts: DataFrame) -> DataFrame:
    """``place, row_key, text``: the texts that had personal information, with typed placeholders for it."""

    @F.pandas_udf("string")
    def mask(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([mask_text(t, [(e["start"], e["end"], e["kind"]) for e in es]) for t, es in zip(text, found)])

    return find_personal(texts).select("place", "row_key", mask("text", "entities").alias("text")).distinct()
