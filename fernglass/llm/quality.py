"""Text quality statistics of documents, and whether a document is prose, a list, a table or junk.

Huge texts are cut into parts at line ends, and at white space within lines that are longer than a part. Parts of one text are rows of
their own, spread over tasks. Each states counts that add up (its words, characters, symbols, lines by form) and, where a line goes on
over its borders, the state of that line as counts, which the merge adds up in order before it judges the line. Ratios and the form
follow from the sums by rules."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text that are counted at once; only a line longer than that is judged by the sums of its parts.
PART = 65_536

#: Frequent function words of English, German, French, Spanish and Dutch.
COMMON_WORDS = frozenset(
    """a about after again all also an and any are as at be because been before but by can could did do does done each for from had has have he her
    his how i if in into is it its just last least like made make may me more most mostly must my nobody no not now of on once one only or other our out
    over please she should so some someone than that the their them then there these they this those thus to too two until up very was we were what when
    where whenever which while who why will with would yet you your
    aber als am an auch auf aus bei bevor bis bitte da damit danach das dass dem den der des die durch ein eine einen einer eines erneut es für gab gestern
    haben hat ich ihr im ist kein mehr mit muss man nach nicht noch oder sehr sich sie sind sodass um und vom von vor war warum was weil wenn wer
    werden wie wir wird wurde wurden zu zum zur über
    au aux avant avec ce cela cette dans de depuis des donc du elle en encore est et il ils je jamais la le les leur lors mais même ne nous on ont ou où
    par parce pas pendant plus pour plupart puis quand que qui sa sans ses si son sous sur tout très un une vous été être cas faut doit
    al antes así como con cuando de debe del desde después donde el ella en era es esta este está fue ha hasta hay la las lo los mientras muy más no nos
    nuestro o para pero por porque que quedó se si sin sobre su también tras un una usar y ya se lo
    aan als bij dan dat de die dit door een en er geen goed had heeft het hij hoe ik in is je kan maar meer met moet na naar niet nog nu of om omdat ook op
    over te tot uit u van veel voor voordat waar was wat we werd weer wij worden wordt ze zijn zo zodat""".split()
)
#: Words of page navigation.
NAVIGATION = frozenset("menu next previous prev search print share home top back cookies cookie login logout accept close skip subscribe sitemap contact".split())

# the standard module is three times as fast on the patterns that see every character
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+")
_SYMBOL = re.compile(r"[^\w\s]|_")
_CLOSING = " \t\r\"'”’»)]"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’„«»…–—•·¿¡°§€£"
_ENDS = frozenset(".!?…。！？:;")
_ITEM = re.compile(r"^\s*(?:[-*+•‣◦·–—▪●○]|\[[ xX]?\]|☐|☑|☒|\(?\d{1,4}[.):]|\(?[a-zA-Z]{1,4}[.)]|#\d+|\d+(?:\.\d+)+\.?)\s+\S")
_GAPS = re.compile(r"\S(?: {2,}|\t+)(?=\S)|\t")
_DELIMITED = re.compile(r"[;,](?=\S|$)|;")
_HEX = re.compile(r"^\s*(?:[0-9a-fA-F]{6,}[:\s]|(?:0x)?[0-9a-fA-F]{2}(?:[\s:][0-9a-fA-F]{2}){6,})|(?:\b[0-9a-fA-F]{2}\s){6,}")
_LONG = re.compile(r"[A-Za-z0-9+/=_\-]{32,}")
_FILL = re.compile(r"([^\w\s])(?:\s*\1){7,}")
_ODD = regex.compile(r"[^\s\p{L}\p{M}\p{N}.,;:!?'\"()\[\]{}/|\\\-–—_*#+=<>@%&$€£°²³•…“”„‘’«»`~^]")
_MIXED = re.compile(r"[¤¬¶§¿¡ŸžœÃÂÐß€ïâ�]")

#: Forms of a line; their characters are counted.
FORMS = ("prose", "list", "table", "junk", "number")
_COUNTS = ("words", "letters_in_words", "symbols", "visible", "lines", "ended_lines", "common", *(f"c_{f}" for f in FORMS), *(f"l_{f}" for f in FORMS))


_VOWELS = re.compile(r"[aeiouyàáâäãåèéêëìíîïòóôöõùúûüýæœø]", re.I)
_CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxz]{4,}|[aeiou]{4,}|[bcdfghjkmnpqtvwxz]{3,}$|^[bcdfghjkmnpqrtvwxz]{3,}|q[^u]|(?:^|[^aeiou])[jvwxz][bcdfghjkmnpqrtvwxz]|^(?:[kg]w|[hjlmnrwx][bcdfghjklmnpqrstvwxz])|[bcdfghjkmnpqvwxz][jqx]", re.I)


def unreadable(word: str) -> bool:
    """Whether a word of letters can't be said: no vowel, or a run of letters that no word has."""
    return len(word) >= 3 and (not _VOWELS.search(word) or bool(_CLUSTER.search(word)))


#: What the form of a line depends on, each from the line (with ``words_`` and the like, which are not handed on), worked out when it is first asked for.
_STATE = {
    "visible": lambda s: sum(map(len, s.tokens_)),
    "words": lambda s: len(s.words_),
    "alphabetic": lambda s: len(s.alphabetic_),
    "odd": lambda s: len(_ODD.findall(s.line_)) + len(_MIXED.findall(s.line_)),
    "symbols": lambda s: len(_SYMBOL.findall(s.line_)),
    "unreadable": lambda s: sum(map(unreadable, s.alphabetic_)),
    "navigation": lambda s: sum(w.lower() in NAVIGATION for w in s.words_),
    "gaps": lambda s: len(_GAPS.findall(s.bare_)),
    "bars": lambda s: s.line_.count("|"),
    "marks": lambda s: len(_DELIMITED.findall(s.line_)),
    "spaced_marks": lambda s: s.line_.count(", ") + s.line_.count("; "),
    "filled": lambda s: bool(_FILL.search(s.line_)),
    "rest": lambda s: len(_WORD.sub("", s.line_).replace(" ", "")),
    "hexes": lambda s: bool(_HEX.search(s.line_)),
    "long": lambda s: len(s.long_.group()) if s.long_ else 0,
    "long_upper": lambda s: bool(s.long_) and not s.long_.group().islower(),
    "longest": lambda s: max(map(len, s.words_), default=0),
    "prose_sign": lambda s: "|" not in s.line_ and "\t" not in s.line_ and "  " not in s.bare_,
    "rule": lambda s: "|" in s.line_ or "+-" in s.line_,
    "first_bar": lambda s: s.bare_[:1] == "|",
    "item": lambda s: s.starts_ and bool(_ITEM.match(s.line_)),
    "ends": lambda s: s.line_.rstrip(_CLOSING)[-1:] in _ENDS,
    "bare_": lambda s: s.line_.strip(),
    "words_": lambda s: _WORD.findall(s.line_),
    "alphabetic_": lambda s: [w for w in s.words_ if w[0].isalpha()],
    "long_": lambda s: _LONG.search(s.line_),
}
#: What is handed on of a line's part, and how parts are joined if not by their sum.
_HANDED = ("tokens", "common", *(n for n in _STATE if not n.endswith("_")))
_JOINED = dict.fromkeys(("filled", "hexes", "long", "long_upper", "longest", "rule"), max) | {"prose_sign": min, "item": lambda v: v[0], "first_bar": lambda v: v[0], "ends": lambda v: v[-1]}


class LineState:
    """What the form of a line depends on. The states of a line's parts add up: counts by sums, findings by or, lengths by the greater."""

    def __init__(self, line: str, tokens: list[str], common: int, starts: bool = True) -> None:
        self.line_, self.tokens_, self.tokens, self.common, self.starts_ = line, tokens, len(tokens), common, starts

    def __getattr__(self, name: str):
        value = self.__dict__[name] = _STATE[name](self)
        return value

    def values(self) -> list[int]:
        return [int(getattr(self, n)) for n in _HANDED]

    @classmethod
    def joined(cls, parts: list[list[int]]) -> LineState:
        """The state of a line from the values of its parts in order."""
        out = cls("", [], 0)
        out.__dict__ |= {name: _JOINED.get(name, sum)(values) for name, values in zip(_HANDED, zip(*parts))}
        return out


def form_of(s: LineState) -> str:
    """The form of a line that is not blank."""
    n = s.words
    if s.common >= 2 and s.common >= 0.15 * s.tokens and s.prose_sign and not s.item:
        return "prose"
    if s.filled and s.rest > 0.8 * s.visible:
        if s.rule or s.visible < 8:  # a rule under a table's head
            return "table"
        return "junk"
    if s.hexes or s.odd > 0.2 * s.visible or (n and s.long > 0.6 * s.visible and s.long_upper):
        return "junk"
    if n >= 4 and s.navigation > 0.7 * n:
        return "junk"
    if s.symbols > 0.3 * s.visible and s.tokens >= 5 and s.longest <= 3 and not s.first_bar:
        return "junk"
    if not s.alphabetic:
        return "number" if n else "junk"
    cells = max(s.gaps, s.bars)
    if cells >= 2 or (cells == 1 and n <= 6 and s.common <= 1):
        return "table"
    if s.marks >= 2 and s.marks >= 0.25 * n and s.common <= 0.2 * n and s.spaced_marks < s.marks:
        return "table"
    if s.item and (n <= 12 or not s.ends) and s.common <= max(1, 0.3 * n):
        return "list"
    if s.common >= max(1, 0.12 * n):
        return "prose"
    if n >= 3 and s.unreadable >= 0.3 * s.alphabetic:
        return "junk"
    return "list" if n <= 8 and not s.ends else "prose"


def line_form(line: str, tokens: list[str], common: int) -> str:
    """The form of one line that is not blank; ``tokens`` are what white space parts in it, ``common`` how many are common words."""
    if common >= 2 and common >= 0.15 * len(tokens) and "|" not in line and "\t" not in line and "  " not in line.strip() and not _ITEM.match(line):
        return "prose"  # the most frequent case, without the rest of the state
    return form_of(LineState(line, tokens, common))


def _count_line(line: str, tokens: list[str]) -> tuple[int, int, int, int]:
    """Words, symbols, common words and visible characters of a line."""
    visible = sum(map(len, tokens))
    plain, marked = [], []
    for token in tokens:
        (plain if token.isalnum() else marked).append(token)
    usual = sum(map(COMMON_WORDS.__contains__, map(str.lower, plain)))
    words, symbols = len(plain), 0
    if marked:
        bare = [t for m in marked if (t := m.strip(_MARKS))]
        usual += sum(map(COMMON_WORDS.__contains__, map(str.lower, bare)))
        words += len(bare)
        symbols = len(_SYMBOL.findall(" ".join(marked)))
    return words, symbols, usual, visible


def part_counts(text: str, tally: Counter, goes_on: bool = False, open_: bool = False) -> list[list[int]]:
    """Add the counts of a part of a text to ``tally``. Where its first line goes on from the part before, or its last one into the next,
    that line's form is left to the merge: ``[[first, last], state...]`` of such lines are returned, one or two."""
    words = symbols = common = seen = lines = ended = 0
    states: list[list[int]] = []
    every = text.split("\n")
    for number, line in enumerate(every):
        tokens = line.split()
        first, last = goes_on and number == 0, open_ and number == len(every) - 1
        if not tokens and not first and not last:
            continue
        more = _count_line(line, tokens)
        words, symbols, common, seen = words + more[0], symbols + more[1], common + more[2], seen + more[3]
        if first or last:
            states.append([int(first), int(last), *LineState(line, tokens, more[2], starts=not first).values()])
            continue
        form = line_form(line, tokens, more[2])
        lines += 1
        ended += line.rstrip(_CLOSING)[-1:] in _ENDS
        tally["c_" + form] += more[3]
        tally["l_" + form] += 1
    for name, value in zip(_COUNTS, (words, seen - symbols, symbols, seen, lines, ended, common)):
        tally[name] += value
    return states


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "_key", "_part", "_states", *_COUNTS]
    for batch in batches:
        columns: list[list] = [[] for _ in names]
        for doc, key, part, text, goes_on, open_ in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_key", "_part", "_text", "_goes_on", "_open"))):
            tally: Counter = Counter()
            states = part_counts(text, tally, goes_on, open_)
            for column, value in zip(columns, (doc, key, part, states or None, *(tally[c] for c in _COUNTS))):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.list_(pa.int64())), *[pa.int64()] * len(_COUNTS)]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _add_open_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the lines that went over borders judged by their added states and counted; most have none."""
    for batch in batches:
        own = {c: batch.column(c).to_pylist() for c in _COUNTS} if batch.column("_lines").null_count < len(batch) else None
        if own:
            for k, parts in enumerate(batch.column("_lines").to_pylist()):
                line: list[list[int]] = []
                for _, states in sorted((p["_part"], p["_states"]) for p in parts or ()):
                    for state in states:
                        line.append(state[2:])
                        if not state[1]:  # the line ends here
                            _count_open(line, own, k)
                            line = []
                if line:
                    _count_open(line, own, k)
        counts = [pa.array(own[c], pa.int64()) if own else batch.column(c) for c in _COUNTS]
        yield pa.record_batch([batch.column("doc_id"), batch.column("_key"), *counts], ["doc_id", "_key", *_COUNTS])


def _count_open(parts: list[list[int]], own: dict[str, list[int]], k: int) -> None:
    state = LineState.joined(parts)
    if state.visible:
        form = form_of(state)
        for name, n in (("lines", 1), ("ended_lines", int(state.ends)), ("c_" + form, state.visible), ("l_" + form, 1)):
            own[name][k] += n


def _in_parts(rows: DataFrame, part: int) -> DataFrame:
    """``doc_id, _key, _part, _text, _goes_on, _open`` of texts over ``part`` characters: cut at the last line end within ``part``, else at the last white
    space, else there. The cut is made where the text is read, and the parts of a text then go to tasks of their own."""
    pieces = F.regexp_extract_all("_text", F.lit(rf"(?s).{{1,{part - 1}}}\n|.{{1,{part}}}(?=\s)|.{{1,{part}}}"), F.lit(0))
    rows = rows.select("doc_id", "_key", pieces.alias("_pieces"))
    ends = lambda x: x.endswith(F.lit("\n"))
    marked = F.transform("_pieces", lambda x, i: F.struct(x.alias("_text"), F.when(i == 0, False).otherwise(~ends(F.get("_pieces", i - 1))).alias("_goes_on"), (~ends(x) & (i < F.size("_pieces") - 1)).alias("_open")))
    parts = rows.select("doc_id", "_key", F.posexplode(marked).alias("_part", "p")).select("doc_id", "_key", "_part", "p.*")
    return parts.repartition(F.col("_key"), F.col("_part"))


def text_statistics(documents: DataFrame, part: int = PART) -> DataFrame:
    """``doc_id, word_count, mean_word_length, symbol_ratio, ended_line_share, common_word_share, form`` of each text that is not null or blank.

    A word is what white space parts and more than punctuation is left of; its length counts letters and digits. ``symbol_ratio`` is other signs by
    visible characters; lines that are blank do not count. Ratios of nothing are 0. Repeated rows of a document with one text are
    one, texts that differ under one id are several; other columns are left out."""
    rows = documents.select("doc_id", F.col("text").alias("_text")).filter(F.col("_text").rlike(r"[^\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"))
    rows = rows.withColumn("_key", F.xxhash64("_text"))
    kinds = ", ".join(f"{c} long" for c in _COUNTS)
    large = F.length("_text") > part
    whole = rows.filter(~large).select("doc_id", "_key", F.lit(0).alias("_part"), "_text", F.lit(False).alias("_goes_on"), F.lit(False).alias("_open"))
    counted = whole.unionByName(_in_parts(rows.filter(large), part)).mapInArrow(_count, f"doc_id long, _key long, _part int, _states array<array<long>>, {kinds}")
    once = counted.groupBy("doc_id", "_key", "_part").agg(F.any_value("_states").alias("_states"), *(F.any_value(c).alias(c) for c in _COUNTS))
    lines = F.collect_list(F.when(F.col("_states").isNotNull(), F.struct("_part", "_states")))
    sums = once.groupBy("doc_id", "_key").agg(*(F.sum(c).alias(c) for c in _COUNTS), lines.alias("_lines"))
    sums = sums.withColumn("_lines", F.when(F.size("_lines") > 0, F.col("_lines")))
    return _judge(sums.mapInArrow(_add_open_lines, f"doc_id long, _key long, {kinds}"))


def _judge(counts: DataFrame) -> DataFrame:
    """Ratios and the form. Lines of numbers alone are cells or entries in a table's or list's company, and a dump on their own."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    total = F.col("c_prose") + F.col("c_list") + F.col("c_table") + F.col("c_junk") + F.col("c_number")
    with_table = (F.col("c_table") > 0) & (F.col("c_table") >= F.col("c_list"))
    with_list = ~with_table & (F.col("c_list") > 0)
    tabled = F.col("c_table") + F.when(with_table, F.col("c_number")).otherwise(0)
    listed = F.col("c_list") + F.when(with_list, F.col("c_number")).otherwise(0)
    junk = F.col("c_junk") + F.when(~with_table & ~with_list, F.col("c_number")).otherwise(0)
    best = F.greatest(listed, tabled, junk)
    form = F.when((F.col("c_prose") * 2 >= total) | (best == 0), "prose").when(junk == best, "junk").when(tabled == best, "table").otherwise("list")
    return counts.select(
        "doc_id",
        F.col("words").alias("word_count"),
        share("letters_in_words", "words").alias("mean_word_length"),
        share("symbols", "visible").alias("symbol_ratio"),
        share("ended_lines", "lines").alias("ended_line_share"),
        share("common", "words").alias("common_word_share"),
        form.alias("form"),
    )
