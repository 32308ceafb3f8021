"""Linking of the spellings of names typed by people: a prefix-filtered set-similarity join on the q-grams of the tokens of the rare
part of a name, in any order, decided by soft token similarity in which rare tokens count more, and a resolution of what goes beside
it (line of trade, given name)."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .lexicon import GIVEN_NAMES, LEGAL_FORMS, SHORT_FORMS, TITLES, TRADE_WORDS

#: Letters in a gram; slips for which a common rare gram is certain; and by how many letters more or less two spellings may differ.
Q, EDITS, LETTERS = 4, 1, 2
#: Least soft similarity of the rare tokens; what a first letter that differs takes off a slip's similarity; how like a slip is between tokens that are both written often.
SOFT, FIRST_LETTER, BOTH_USUAL = 0.75, 0.25, 0.4
#: Spellings that have a token, from which it is usual, and the share of those that have the other token.
USUAL, USUAL_SHARE = 4, 0.2
#: Pairs of the table of nicknames, which every task has whole; more raise.
NICKNAMES = 100_000

_TOKEN = regex.compile(r"\p{L}+(?:[’'`]\p{L}+)*")


def one_edit(a: str, b: str) -> bool:
    """Whether b is a or differs from it by one letter put in, left out, replaced or swapped with its neighbour."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])
    return a[k:] == b[k + 1 :]


def abbreviates(short: str, word: str) -> bool:
    """Whether ``short`` is ``word`` with letters left out after the first."""
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return False
    rest = iter(word[1:])
    return all(c in rest for c in short[1:])


@lru_cache(maxsize=200_000)
def trade_of(token: str) -> str | None:
    """The trade word that a token is, abbreviates or misspells; words between which nothing decides are joined by a slash."""
    if token in TRADE_WORDS:
        return token
    if token in GIVEN_NAMES or token in SHORT_FORMS:
        return None
    if len(token) >= 5:
        near = [w for w in TRADE_WORDS if one_edit(token, w)]
        if near:
            return min(near)
    shared = lambda w: next((i for i, (x, y) in enumerate(zip(token, w)) if x != y), min(len(token), len(w)))
    short = [w for w in TRADE_WORDS if abbreviates(token, w)]
    most = max(map(shared, short), default=0)
    return "/".join(sorted(w for w in short if shared(w) == most)) or None


@lru_cache(maxsize=200_000)
def given_of(token: str, nicknames: tuple[tuple[str, str], ...]) -> str | None:
    """The given name that a token is, is short for, or misspells."""
    table = dict(nicknames)
    if token in GIVEN_NAMES or token in table.values():
        return token
    if token in table or token in SHORT_FORMS:
        return table.get(token) or SHORT_FORMS[token]
    if len(token) >= 4:
        near = sorted(g for g in {*GIVEN_NAMES, *table.values()} if one_edit(token, g) and len(g) >= 4)
        return near[0] if near else None
    return None


def parse(name: str, nicknames: tuple[tuple[str, str], ...]) -> tuple[list[str], list[str], str, str, bool]:
    """``(rare tokens, trade words, given name, initial, has a title)`` of a spelling. Numbers, signs and legal forms are dropped.

    If every token has a role besides, all are rare tokens, so that no spelling is left without any."""
    text = unicodedata.normalize("NFKC", name).lower()
    text = regex.sub(r"(?<=\p{L})\.(?=\p{L}(?:\.|\b))", "", text)  # b.v. is one token
    tokens = [regex.sub(r"[’'`]", "", t) for t in _TOKEN.findall(text)]
    rare, trade, given, initial, titled = [], [], "", "", False
    for position, token in enumerate(tokens):
        if token in LEGAL_FORMS and (len(token) > 1 or position):
            if len(token) > 1:
                continue
        if token in TITLES and len(token) > 1:
            titled = True
        elif len(token) == 1:
            initial = initial or token
        elif not given and (found := given_of(token, nicknames)):
            given = found
        elif word := trade_of(token):
            trade.append(word)
        else:
            rare.append(token)
    if not rare:
        return [t for t in tokens if t not in LEGAL_FORMS] or tokens, [], "", "", titled
    return rare, sorted(set(trade)), given, initial, titled


def _parse_all(nicknames: tuple[tuple[str, str], ...]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [parse(m, nicknames) for m in frame["merchant"]]
            yield pd.DataFrame(
                {
                    "merchant": frame["merchant"],
                    "n_rows": frame["n_rows"],
                    "tokens": [p[0] for p in parts],
                    "core": ["".join(p[0]) for p in parts],
                    "trade": [p[1] for p in parts],
                    "given": [p[2] for p in parts],
                    "initial": [p[3] for p in parts],
                }
            )

    return run


def grams(word: Column, q: int = Q) -> Column:
    """The q-grams of a word with its ends marked, so that an edit touches at most q + 1 of them."""
    padded = F.concat(F.lit("^" * (q - 1)), word, F.lit("$" * (q - 1)))
    return F.transform(F.sequence(F.lit(1), F.length(word) + q - 1), lambda i: F.substring(padded, i, q))


def cut_forms(tokens: Column, least: int = 3) -> Column:
    """The cores that result if one token of a name of several is abbreviated to its start."""

    def shortened(token: Column, at: Column) -> Column:
        lengths = F.when(F.length(token) > least, F.sequence(F.lit(least), F.length(token) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(lengths, lambda n: F.concat_ws("", F.slice(tokens, F.lit(1), at), F.substring(token, F.lit(1), n), F.slice(tokens, at + 2, F.size(tokens))))

    return F.when(F.size(tokens) > 1, F.array_distinct(F.flatten(F.transform(tokens, shortened)))).otherwise(F.array().cast("array<string>"))


def slip_similarity(a: str, b: str, n_a: int = 1, n_b: int = 1) -> float:
    """How like two tokens are: 1 if equal, less for one slip by its share of the letters, 0 else.

    People seldom mistype a first letter. Two tokens that are both usual (``n_a`` and ``n_b`` spellings have them) are two names rather than one and its slip."""
    if a == b:
        return 1.0
    if min(len(a), len(b)) < 3 or not one_edit(a, b):
        return 0.0
    if min(n_a, n_b) >= USUAL and min(n_a, n_b) >= USUAL_SHARE * max(n_a, n_b):
        return BOTH_USUAL
    replaced = len(a) == len(b) and a[0] != b[0] and a[1:] == b[1:]
    return 1 - 1 / max(len(a), len(b)) - FIRST_LETTER * replaced


def soft_similarity(a: list[str], b: list[str], n_a: list[int], n_b: list[int], total: int) -> float:
    """The mean over both sides of how well each token is met by one of the other side, each used once; a token counts by the logarithm of how rare it is.

    Tokens that are written as one on a side are compared as one, in order."""
    if len(a) != len(b):
        return slip_similarity("".join(a), "".join(b), min(n_a), min(n_b))
    weight_a, weight_b = ([math.log((total + 1) / n) + 0.01 for n in counts] for counts in (n_a, n_b))
    scored = sorted(((slip_similarity(x, y, n, m), -i, -j) for i, (x, n) in enumerate(zip(a, n_a)) for j, (y, m) in enumerate(zip(b, n_b))), reverse=True)
    met_a, met_b = [0.0] * len(a), [0.0] * len(b)
    free_a, free_b = set(range(len(a))), set(range(len(b)))
    for value, i, j in scored:
        if -i in free_a and -j in free_b:
            free_a.remove(-i)
            free_b.remove(-j)
            met_a[-i] = met_b[-j] = value
    side = lambda met, weight: sum(m * w for m, w in zip(met, weight)) / sum(weight)
    return (side(met_a, weight_a) + side(met_b, weight_b)) / 2


def _verify(total: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ok = [soft_similarity(list(s), list(t), list(v), list(w), total) >= SOFT for s, t, v, w in zip(f["a_tokens"], f["b_tokens"], f["a_counts"], f["b_counts"])]
            yield f.loc[ok, ["a", "b"]]

    return run


def _similar_cores(parsed: DataFrame) -> DataFrame:
    """``a, b`` in both orders: cores whose tokens are alike in any order, or alike if written as one, by prefix-filtered joins on grams."""
    total = parsed.count()
    tokens = parsed.select("merchant", F.explode("tokens").alias("token")).distinct().groupBy("token").agg(F.count("*").alias("n"))
    cores = parsed.groupBy("core").agg(F.min("tokens").alias("tokens"))
    counts = cores.select("core", F.posexplode("tokens").alias("at", "token")).join(tokens, "token")
    counts = counts.groupBy("core").agg(F.array_sort(F.collect_list(F.struct("at", F.col("n").cast("int").alias("n")))).alias("s"))
    cores = cut(cores.join(counts, "core").select("core", "tokens", F.col("s.n").alias("counts")))
    # a core is met by the grams of its tokens, whatever their order, and by those of its tokens written as one
    apart, together = F.array_distinct(F.flatten(F.transform("tokens", lambda t: grams(t)))), F.array_distinct(grams(F.concat_ws("", "tokens")))
    forms = F.array(F.struct(F.lit(0).alias("form"), apart.alias("grams")), F.struct(F.lit(1).alias("form"), together.alias("grams")))
    every = cores.select("core", F.explode(F.when(F.size("tokens") > 1, forms).otherwise(F.slice(forms, 2, 1))).alias("f")).select("core", "f.form", F.explode("f.grams").alias("gram"))
    shared = every.groupBy("form", "gram").agg(F.count("*").alias("n"))
    # one slip leaves all but q + 1 grams, so cores one slip apart share one of their q + 2 rarest; two slips in two tokens mostly leave one of these as well
    ordered = every.join(shared, ["form", "gram"]).groupBy("core", "form").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("p"))
    prefix = ordered.select("core", "form", F.explode(F.slice("p", 1, EDITS * (Q + 1) + 1)).alias("g")).select("core", "form", F.col("g.gram").alias("gram"))
    side = lambda p: prefix.select(F.col("core").alias(p), "form", "gram")
    pairs = side("a").join(side("b"), ["form", "gram"])
    pairs = pairs.filter((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= LETTERS)).select("a", "b").distinct()
    tokens_of = lambda p: cores.select(F.col("core").alias(p), F.col("tokens").alias(f"{p}_tokens"), F.col("counts").alias(f"{p}_counts"))
    checked = pairs.join(tokens_of("a"), "a").join(tokens_of("b"), "b").mapInPandas(_verify(total), "a string, b string")
    # an abbreviated token is met by an equality join on the abbreviations of the others
    short = cores.select(F.col("core").alias("b"), F.explode(cut_forms(F.col("tokens"))).alias("a"))
    cut_off = short.join(cores.select(F.col("core").alias("a")), "a").select("a", "b")
    return checked.unionByName(checked.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(cut_off).distinct()


def _roots(parsed: DataFrame) -> DataFrame:
    """``core, root``: each core hangs on its most used similar core that is more used than itself; roots are found by pointer jumping until none moves."""
    used = parsed.groupBy("core").agg(F.struct(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n")).alias("use"))
    links = _similar_cores(parsed).join(used.select(F.col("core").alias("a"), F.col("use").alias("a_use")), "a").join(used.select(F.col("core").alias("b"), F.col("use").alias("b_use")), "b")
    up = links.filter(F.struct("b_use", "b") > F.struct("a_use", "a")).groupBy("a").agg(F.max(F.struct("b_use", "b")).alias("best"))
    roots = used.select("core").join(up.select(F.col("a").alias("core"), F.col("best.b").alias("up")), "core", "left").select("core", F.coalesce("up", "core").alias("root"))
    roots = cut(roots)  # each round reads it twice
    while True:  # a chain of n links takes log2(n) rounds
        step = roots.select(F.col("core").alias("root"), F.col("root").alias("next"))
        roots = cut(roots.join(step, "root").select("core", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        moved = roots.filter("moved").limit(1).count()
        roots = roots.drop("moved")
        if not moved:
            return roots


def _assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for root, sides in zip(frame["root"], frame["sides"]):
            for s, label in zip(sides, resolve([(tuple(s["trade"]), s["given"], s["initial"], s["n"]) for s in sides])):
                out.append((root, "|".join(s["trade"]), s["given"], s["initial"], label))
        yield pd.DataFrame(out, columns=["root", "trades", "given", "initial", "label"])


def resolve(sides: list[tuple[tuple[str, ...], str, str, int]]) -> list[str]:
    """A label for each ``(trade words, given name, initial, rows)`` beside one rare part; equal labels are one entity.

    A given name makes a person; trade words a firm. Trade words that are part of one other set, and an initial of one
    given name, join it; of several the most used. Nothing at all joins the most used."""
    trades: dict[tuple[str, ...], int] = {}
    givens: dict[str, int] = {}
    for trade, given, _, n in sides:
        if given:
            givens[given] = givens.get(given, 0) + n
        elif trade:
            trades[trade] = trades.get(trade, 0) + n
    clear = [t for t in trades if not any("/" in w for w in t)] or list(trades)
    whole = [t for t in clear if not any(set(t) < set(o) for o in clear)]
    inside = lambda part, of: all(any(w in of for w in p.split("/")) or p in of for p in part)
    initials: dict[str, int] = {}
    for trade, given, initial, n in sides:
        if initial and not given and not trade and not any(g[0] == initial for g in givens):
            initials[initial] = initials.get(initial, 0) + n
    persons = {f"person {g}": n for g, n in givens.items()} | {f"person {i}": n for i, n in initials.items()}
    firms = {f"firm {' '.join(t)}": sum(m for o, m in trades.items() if inside(o, t)) for t in whole}
    best = lambda of: max(of, key=lambda k: (of[k], k))
    labels = []
    for trade, given, initial, _ in sides:
        if given:
            labels.append(f"person {given}")
        elif trade:
            fits = {k: n for k, n in firms.items() if inside(trade, k.split()[1:])}
            labels.append(best(fits) if fits else f"firm {' '.join(trade)}")
        elif initial and (fit := {k: n for k, n in persons.items() if k[7] == initial}):
            labels.append(best(fit))
        else:
            every = persons | firms
            labels.append(best(every) if every else "")
    return labels


def link_names(ledger: DataFrame, nicknames: DataFrame) -> DataFrame:
    """``merchant, entity``: each distinct spelling, exactly as stored, with the entity that it belongs to.

    Null, blank and ``?`` spellings, and ones without a letter, are left out. ``entity`` is the rare part of the most used
    spelling and what tells its entities apart. ``nicknames`` (``given, nickname``) is a dimension of given names, of which more
    than ``NICKNAMES`` pairs raise; null entries are skipped. Other columns are left out; empty tables give no rows."""
    pairs = nicknames.select("given", "nickname").dropna().distinct().limit(NICKNAMES + 1).collect()
    if len(pairs) > NICKNAMES:
        raise ValueError(f"more than {NICKNAMES} nicknames: every task has the table whole, so it must be a dimension")
    table = tuple(sorted((r["nickname"].strip().lower(), r["given"].strip().lower()) for r in pairs))
    strings = ledger.select("merchant").filter(F.col("merchant").rlike(r"\p{L}")).groupBy("merchant").agg(F.count("*").alias("n_rows"))
    schema = "merchant string, n_rows long, tokens array<string>, core string, trade array<string>, given string, initial string"
    parsed = strings.mapInPandas(_parse_all(table), schema)
    parsed = cut(parsed)
    roots = _roots(parsed)
    rows = parsed.join(roots, "core").withColumn("trades", F.array_join("trade", "|"))
    # beside one rare part there are only so many trades, given names and initials, so this group is small whatever the rows
    sides = rows.groupBy("root", "trade", "given", "initial").agg(F.sum("n_rows").alias("n"))
    sides = sides.groupBy("root").agg(F.collect_list(F.struct("trade", "given", "initial", "n")).alias("sides"))
    labels = sides.mapInPandas(_assign, "root string, trades string, given string, initial string, label string")
    found = rows.join(labels, ["root", "trades", "given", "initial"])
    return found.select("merchant", F.concat_ws(" / ", "root", "label").alias("entity"))


#: Spellings of an entity that one task pairs with all others of it.
PAIRED_AT_ONCE = 1000


def same_entity_pairs(links: DataFrame) -> DataFrame:
    """``merchant_a, merchant_b``: the pairs of spellings of one entity, the smaller one first. An entity with many spellings is many tasks."""
    parts = links.groupBy("entity").agg(F.ceil(F.count("*") / PAIRED_AT_ONCE).cast("int").alias("_parts"))
    sized = links.join(parts, "entity")
    a = sized.select(F.col("merchant").alias("merchant_a"), "entity", F.pmod(F.xxhash64("merchant"), F.col("_parts")).cast("int").alias("_part"))
    b = sized.select(F.col("merchant").alias("merchant_b"), "entity", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return a.join(b, ["entity", "_part"]).filter("merchant_a < merchant_b").select("merchant_a", "merchant_b")
