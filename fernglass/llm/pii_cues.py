"""Precise cues of personal information. They label the bounded sample that the field of ``pii`` is fitted to, and nothing else: what
is found in a corpus is found by the field, from features of its own."""

from __future__ import annotations

import re

from .lexicon import GIVEN_NAMES, SHORT_FORMS, TITLES
from .quality import COMMON_WORDS

_LOCAL = r"[\w.+'\-]*\w"
_EMAIL = re.compile(rf"<?{_LOCAL}@\w[\w\-]*(?:-\n\w+)?(?:\.\n?\w[\w\-]*)*\.[A-Za-z]{{2,}}>?")
_AT = r"(?:\s*[(\[{<]\s*(?:at|arroba|ät)\s*[)\]}>]\s*|\s+at\s+|\s+AT\s+|\s*@\s*)"
_DOT = r"(?:\s*[(\[{<]\s*(?:dot|punkt|punto|point|punt)\s*[)\]}>]\s*|\s+(?:dot|DOT)\s+)"
_SPELT = re.compile(rf"{_LOCAL}(?:{_DOT}{_LOCAL})*{_AT}\w[\w\-]*(?:(?:{_DOT}|\.)\w[\w\-]*)+", re.I)
_NUMBER = re.compile(r"(?:\+ ?|\b00|\()?\d+(?:(?:[ .\-/]|\n|\) ?|\)-| ?\(|-\()\d+)*")
_EXACT_ID = re.compile(r"\b(?:\d{3}-\d{2}-\d{4}|[A-Z]{2}[ \-]?\d{2}[ \-]?\d{2}[ \-]?\d{2}[ \-]?[A-D]|[A-Z]{5}\d{6}[A-Z0-9]{2,5}|[A-Z]{1,2}\d{7,8}|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-HJ-NP-TV-Z])\b", re.I)
_ID_CUE = re.compile(
    r"(?:\bssn\b|social[\s\-]security|national[\s\-]insurance|\bni\s*n|\bnino\b|\btax[\s\-]?(?:id|no|number)|\btin\b|steuer|\bidnr|\bid[\s\-]?nr|passport(?:\s*(?:n|#|:))|reisepass|passeport|pasaporte|paspoort|driv(?:ing|er'?s?)[\s\-]licen[cs]e|führerschein|rijbewijs|permis\sde|permiso\sde|s[ée]curit[ée]\s+sociale|\bbsn\b|burgerservice|\bdni\b|\bnie\b|\bnif\b|personalausweis|sozialversicherung|id\son\sfile|for\sidentification|form\sshows|holder'?s)[^\n.;]{0,28}$|(?:id\son\sfile|for\sidentification|form\sshows|holder'?s|wanted)\W*$",
    re.I,
)
_NOT_CUE = re.compile(r"(?:\border|\breference|\bref\b|\bserial|\bpart\b|\blot\b|\binvoice|\barticle|\bfigure|\bcard|\bsku|\btorque|\bversion|\bpackage|\breplaces|\bclause|\biban|\baccount|\bsequence|\bmodel|\brouting|\bbatch|\bticket)[^\n.;:]{0,18}$", re.I)
_PHONE_CUE = re.compile(r"(?:\btel\b|phone|\bcall\b|mobile|\bmob\b|\bcell\b|\bfax\b|reach|number|\bring\b|téléphone|telefon|tél|\bmóvil|llamar|anruf|bel\b|ask\b)[^\n;]{0,40}$", re.I)
_STREET_END = r"(?:st|rd|ave|ln|dr|ct|cl|blvd|street|road|lane|close|drive|crescent|cres|way|court|terrace|avenue|place|gardens|grove|row|square|sq|boulevard|walk|mews|hill|park|rise|view|green|quay)"
_EN_AFTER = re.compile(rf"[A-Za-z]?(?:\s?[\-–/]\s?\d+[A-Za-z]?)?,?\s+((?:[^\W\d_][\w'’\-]*\s+){{1,3}}?){_STREET_END}\b\.?", re.I)
_FR_AFTER = re.compile(r"\s?(?:bis|ter|[a-d])?,?\s+(?:rue|avenue|boulevard|bd|place|chemin|impasse|allée|allee|quai|route|cours|square|passage)\s+(?:(?:du|de|des|la|le|les|l['’]|d['’])\s*)*[^\W\d_][\w'’\-]*(?:[\s\-]+(?!\d)[^\W\d_][\w'’\-]*)?", re.I)
_BEFORE = re.compile(
    r"(?:\b(?:(?:am|an\s+der|an\s+den|im|in\s+der|zum|zur|auf\s+dem)\s+(?:[^\W\d_][\w'’\-]*\s+)?)?[^\W\d_]{3,}(?:str\.|straße|strasse|weg|allee|platz|gasse|hof|ring|damm|ufer|wiek|wijk|straat|laan|gracht|kade|plein|dijk|singel|steeg|pad)"
    r"|\b(?:calle|avenida|avda?\.|plaza|paseo|camino|carrer|c/|via|viale|piazza)\s+(?:(?:de|del|la|las|los|el)\s+)*[^\W\d_][\w'’\-]*(?:\s+[^\W\d_][\w'’\-]*)?)\s*,?\s*(?:n[ºo°]?\.?\s*)?$",
    re.I,
)
_BEFORE_ENDS = tuple("str. straße strasse weg allee platz gasse hof ring damm ufer wiek wijk straat laan gracht kade plein dijk singel steeg pad".split())
_BEFORE_STARTS = re.compile(r"\b(?:calle|avenida|avda?\.|plaza|paseo|camino|carrer|c/|via|viale|piazza)\s", re.I)
_AFTER_START = re.compile(r"(?:[A-Za-z]|\s?[\-–/]\s?\d+[A-Za-z]?|\s(?:bis|ter|BIS|TER))?,?\s+[^\W\d_]{3}")
_CODED = re.compile(r"\b[A-Z]{1,5}[ \-]?\d")
_CODED_WORDS = ("passport", "licence", "license", "insurance", "rijbewijs", "paspoort", "pasaporte", "passeport", "reisepass", "dni", "nie")
_HEX_LINE = re.compile(r"(?:\b[0-9a-fA-F]{2}[ :]){6,}")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+|[^\w\s]|_")
_MONTHS = frozenset("january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split())
_GIVENS = GIVEN_NAMES | frozenset(SHORT_FORMS)
_WORDS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    total = sum((2 * d - 9 if 2 * d > 9 else 2 * d) if k % 2 else d for k, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def number_kind(text: str, start: int, end: int) -> str | None:
    """What a run of digit groups is by its form and the words before it."""
    run = text[start:end]
    if run[0] == "(" and ")" not in run:
        run, start = run[1:], start + 1
    digits = re.sub(r"\D", "", run)
    n = len(digits)
    if n < 8 or n > 19:
        return None
    before = text[max(0, start - 60) : start]
    if _NOT_CUE.search(before) or (start and (text[start - 1].isalnum() or text[start - 1] in "@-/.,_#")) or (end < len(text) and (text[end] in "@_" or text[end].isalpha() or text[end : end + 2].strip("-").isalpha() and text[end] == "-")):
        return None
    line = text[text.rfind("\n", 0, start) + 1 : (text.find("\n", end) + 1 or len(text) + 1) - 1]
    if _HEX_LINE.search(line) or "\t" in run:
        return None
    plain = re.sub(r"\s", " ", run)
    if re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", plain) or (_ID_CUE.search(before) and not run.startswith(("+", "("))):
        if n in (8, 9, 10, 11, 12, 13, 15):
            return "id_number"
    if 13 <= n <= 19 and luhn(digits) and not run.startswith("+"):
        return None
    if run.startswith("+") and 9 <= n <= 15:
        return "phone"
    if digits.startswith("00") and 11 <= n <= 15:
        return "phone"
    if re.fullmatch(r"\(?\d{3}\)?[ .\-]{1,2}\d{3}[ .\-]\d{4}", plain):
        return "phone"
    if digits[0] == "0" and 9 <= n <= 12 and re.search(r"\D", plain):
        return "phone"
    if 9 <= n <= 13 and _PHONE_CUE.search(before) and not re.fullmatch(r"[\d.,]+", plain.replace(" ", "")) or (n in (10, 11) and digits[0] == "0" and _PHONE_CUE.search(before)):
        return "phone"
    return None


def spans(text: str, known: frozenset[str]) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of what looks like personal information by form and near context."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(*m.span(), "email") for m in _EMAIL.finditer(text)]
    low = text.lower()
    if "dot" in low or "at)" in low or "at]" in low or "at>" in low or "at}" in low or "punkt" in low or "punto" in low:
        for m in _SPELT.finditer(text):
            piece = m.group().lower()
            bracketed = re.search(r"[(\[{<]\s*(?:at|arroba|ät)\s*[)\]}>]", piece)
            if bracketed or re.search(_DOT, piece) and (re.search(r"\sat\s|@", piece)):
                found.append((*m.span(), "email"))
    mails = list(found)
    inside = lambda a, z: any(s < z and a < e for s, e, _ in mails)
    for m in _NUMBER.finditer(text):
        a, z = m.span()
        if z - a >= 8 and not inside(a, z) and (kind := number_kind(text, a, z)):
            found.append((a + (m.group()[0] == "(" and ")" not in m.group()), z, kind))
            continue
        first = re.match(r"\d+", m.group())
        at = a + len(first.group()) if first else a
        if first and len(first.group()) <= 4 and _AFTER_START.match(text, at) and (a == 0 or not (text[a - 1].isalnum() or text[a - 1] in ".,-@/#")):
            if (hit := _EN_AFTER.match(text, at)) and _street_name(hit.group(1), known):
                found.append((a, hit.end(), "address"))
            elif hit := _FR_AFTER.match(text, at):
                found.append((a, hit.end(), "address"))
        hit = None
        if a and text[a - 1] in " \n,.º°":
            ahead = text[max(0, a - 60) : a]
            if (ahead[:-1].rstrip(",").lower().endswith(_BEFORE_ENDS) and ahead[-1] in " \n") or _BEFORE_STARTS.search(ahead):
                hit = _BEFORE.search(text, max(0, a - 60), a)
        if hit and len(re.match(r"\D*(\d+)", m.group()).group(1)) <= 4 and _street_name(hit.group(), known):
            found.append((hit.start(), a + len(first.group() if first else m.group()), "address"))
    coded = _CODED.search(text) or any(w in low for w in _CODED_WORDS)
    for m in _EXACT_ID.finditer(text) if coded else ():
        a, z = m.span()
        before = text[max(0, a - 60) : a]
        bare = re.fullmatch(r"(?i)[A-Z]{1,2}\d{7,8}|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]", m.group())
        if not inside(a, z) and not _NOT_CUE.search(before) and (not bare or _ID_CUE.search(before) or m.group()[:2].isupper() and bare and m.group()[2:].isdigit()) and (a == 0 or text[a - 1] not in "-@/._") and text[z : z + 1] not in ("-", "@"):
            found.append((a, z, "id_number"))
    found += [s for s in name_spans(text, known) if not inside(s[0], s[1])]
    return sorted(found)


def _street_name(words: str, known: frozenset[str]) -> bool:
    """Whether the words before a kind of street hold a name: in capitals, or a word that is not an everyday one."""
    tokens = _WORDS.findall(words)
    if any(t.lower() in COMMON_WORDS and t.islower() and t.lower() not in ("de", "la", "las", "los", "el", "del", "der", "den", "am", "an", "im", "in", "zum", "zur", "auf", "dem") for t in tokens):
        return False
    return any((t[0].isupper() and t.lower() not in COMMON_WORDS) or (t.lower() not in known and len(t) > 3) for t in tokens)


def _family(token: str, known: frozenset[str]) -> bool:
    return len(token) >= 3 and token.lower() not in known and token.lower() not in COMMON_WORDS and token.lower() not in _MONTHS and token.lower() not in TITLES


_CASED = frozenset(form for w in (*_GIVENS, *(t for t in TITLES if len(t) > 1)) for form in (w, w.capitalize(), w.upper()))
_INITIAL = re.compile(r"\b[A-Za-z]\.(?=[\s,]|$)")
_NAME_TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*\.?")


def name_spans(text: str, known: frozenset[str]) -> list[tuple[int, int, str]]:
    """Family names with a given name, an initial or a title, in either order."""
    cues = _CASED.intersection(_WORDS.findall(text))
    places = [m.start() for m in _INITIAL.finditer(text)] if "." in text else []
    if cues:
        places += [m.start() for m in re.finditer(r"(?<![^\W\d_])(?:" + "|".join(sorted(cues, key=len, reverse=True)) + r")(?![^\W\d_])", text)]
    found: list[tuple[int, int, str]] = []
    areas: list[list[int]] = []
    for at in sorted(places):
        low, high = max(0, at - 40), min(len(text), at + 80)
        if areas and low <= areas[-1][1]:
            areas[-1][1] = high
        else:
            areas.append([low, high])
    for low, high in areas:
        while low and not text[low - 1].isspace():
            low -= 1
        while high < len(text) and not text[high].isspace():
            high += 1
        found += _names_between(text, low, high, known)
    return found


def _names_between(text: str, low: int, high: int, known: frozenset[str]) -> list[tuple[int, int, str]]:
    found = []
    tokens = [(m.group(), m.start(), m.end()) for m in _NAME_TOKEN.finditer(text, low, high)]
    gap = lambda i, j: text[tokens[i][2] : tokens[j][1]] if j < len(tokens) else "\0"
    n = len(tokens)
    for i, (token, a, z) in enumerate(tokens):
        if found and a < found[-1][1]:
            continue
        bare = token.rstrip(".")
        low = bare.lower()
        title, given = low in TITLES and len(low) > 1, low in _GIVENS
        initial = len(bare) == 1 and token.endswith(".") and bare.isalpha()
        if not (title or given or initial) or text[z : z + 3] == "..." or text[a - 1 : a] in ("@",):
            continue
        j, helped = i, title or given or initial
        while j + 1 < n and gap(j, j + 1).strip(" \n") == "" and len(gap(j, j + 1)) <= 2 and gap(j, j + 1).count("\n") < 2:
            nxt = tokens[j + 1][0].rstrip(".")
            if (nxt.lower() in _GIVENS and not tokens[j + 1][0].endswith(".")) or (len(nxt) == 1 and tokens[j + 1][0].endswith(".")) or (nxt.lower() in TITLES and len(nxt) > 1 and j == i and title):
                if nxt.lower() in _GIVENS and not (j + 2 < n and gap(j + 1, j + 2).strip(" \n") == ""):
                    break
                j += 1
                continue
            break
        if j + 1 < n and helped and len(gap(j, j + 1)) <= 2 and gap(j, j + 1).strip(" \n") == "" and gap(j, j + 1).count("\n") < 2:
            nxt, s, e = tokens[j + 1]
            word = nxt.rstrip(".")
            cased = word[0].isupper() or bare[0].islower()
            sentence_end = token.endswith(".") and not (title or initial)
            if cased and not sentence_end and all(_family(p, known) for p in re.split(r"[-’']", word) if len(p) > 1) and text[s + len(word) : s + len(word) + 3] != "..." and not re.match(r"-?\d|\s(?:\d{1,3}\b|Pro\b|RX\b|PRO\b)", text[s + len(word) : s + len(word) + 4]) and (not initial or word[0].isupper() and j > i or _initial_ok(text, a, word)):
                found.append((a, s + len(word), "name"))
                continue
        # family name first: after a comma the given name or the initial
        if (given or initial) and i and gap(i - 1, i) in (", ", ",\n", ","):
            word, s, _ = tokens[i - 1]
            if word[0].isupper() == bare[0].isupper() and _family(word, known) and not word.endswith(".") and len(word) > 3 and not (i >= 2 and tokens[i - 2][0].lower().rstrip(".") in ("the",)):
                found.append((s, z, "name"))
    return found


def _initial_ok(text: str, at: int, word: str) -> bool:
    """An initial before a family name starts a name unless it ends a sentence or numbers a list."""
    return text[at].isupper() and (word[0].isupper()) and not (word.isupper() and len(word) <= 3)
