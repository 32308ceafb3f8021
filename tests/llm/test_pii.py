from random import Random

import numpy as np
import pytest

from fernglass.llm import pii
from fernglass.llm.pii import CLASS, LABELS, Reader, SkipChainField, entities, find_personal, fit_sample, mask_text, number_class, packed, personal_kinds, redact, skip_edges, texts_of, word_class
from fernglass.llm.pii_cues import luhn, name_spans, spans

KNOWN = frozenset("the a pump was replaced by with few remarks lives at order reference applies to part number clause of lane residents guidance may is best iris burner use with frank discussion from".split())


def kinds(text):
    return sorted({k for _, _, k in spans(text, KNOWN)})


@pytest.mark.parametrize(
    "text, want",
    [
        ("write to fred.kaktup+x@mail.holt.invalid today", ["email"]), ("amina+shop at example dot net", ["email"]), ("litkak [at] mail [dot] holt", ["email"]), ("package@2.7.4 and put @override", []),
        ("call +44 (0)7700 900 740", ["phone"]), ("(729) 555-0109", ["phone"]), ("01 99 00 42 77", ["phone"]), ("0049-30-23125-886", ["phone"]), ("664.555.0181", ["phone"]),
        ("Order reference 493-582-479 applies", []), ("torque 30-35-98", []), ("4111 1111 1111 1111", []), ("00000010  7e 40 91 93 43 98 83 74", []),
        ("SSN 987653006", ["id_number"]), ("form shows 666-11-2222", ["id_number"]), ("national insurance QQ-24-52-35-B", ["id_number"]), ("passport no. X0086065", ["id_number"]), ("Steuer-ID 00 012 992 350", ["id_number"]), ("part number 282-563-A", []),
        ("17 Quarry Bank Terrace", ["address"]), ("Am Alten Speicherhof 46a", ["address"]), ("7 bis, rue du Val-Orme", ["address"]), ("Calle de los Almendrales 85", ["address"]), ("Clause 439 of Larkmoor Lane Residents", []), ("BEARING                     2     14.89", []),
        ("by Mme Lobrum with", ["name"]), ("J. Zonlep", ["name"]), ("Tuppul, Patricia", ["name"]), ("Gustav L. Nessif-Lugdim", ["name"]), ("Use the Iris burner", []), ("A frank discussion", []), ("Oliver alone", []), ("personal_name: Fra...m (11 chars)", []), ("", []),
    ],
)
def test_cues(text, want):
    assert kinds(text) == want


def test_names_end_where_they_end():
    assert [text[a:z] for text in ["by Dr Kenji Soksun, 030", "Dear Ms Revdad, thank"] for a, z, _ in name_spans(text, KNOWN)] == ["Dr Kenji Soksun", "Ms Revdad"]
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_classes_are_of_the_token_alone():
    assert [number_class(x) for x in ["7", "987-65-4321", "(753) 555-0150", "+44 20 7946 05", "4111 1111 1111 1111", "14.89", "020 7946 0936"]] == ["digits_1", "ssn", "us_phone", "plus_mid", "card", "decimal", "zero_mid"]
    assert word_class("Gustav", False) == "given_capital" and word_class("Gustav", False, hidden=True) == "unknown_capital" and word_class("pump", True) == "everyday_lower"
    reader = Reader(KNOWN, {})
    t = reader.read(["a@b.org QQ-24-52-35-B x9", ""], [None, None])
    assert [i for i in t.cls if i] == [CLASS["mail"], CLASS["code_nino"], CLASS["code_other"]] and list(np.unique(t.text)) == [0, 1]


def brute(unary, chain, skip, edges):
    from itertools import product

    return list(max(product(range(len(LABELS)), repeat=len(unary)), key=lambda y: sum(unary[i, v] for i, v in enumerate(y)) + sum(chain[a, b] for a, b in zip(y, y[1:])) + sum(skip[y[i], y[j]] for i, j in edges)))


def test_message_passing_against_enumeration():
    rng = np.random.default_rng(2)
    agreed = 0
    for _ in range(12):
        field = SkipChainField({}, rng.normal(size=(6, 6)), np.eye(6) * 1.5)
        unary = rng.normal(size=(5, 6))
        steps = packed(np.array([0]), np.array([5]))
        none = np.zeros((0, 2), int)
        assert list(field.label(unary, none, steps)) == brute(unary, field.chain, field.skip, [])  # exact on chains
        agreed += list(field.label(unary, np.array([(0, 4)]), steps, 30)) == brute(unary, field.chain, field.skip, [(0, 4)])
    assert agreed >= 10


def test_closed_tokens_part_chains_exactly():
    rng = np.random.default_rng(4)
    field = SkipChainField({}, rng.normal(size=(6, 6)), np.zeros((6, 6)))
    unary = rng.normal(size=(40, 6)) * 2
    unary[:, 0] += 12 * (rng.random(40) < 0.5)
    real = np.r_[False, np.ones(38, bool), False]
    whole = field.beliefs(unary, packed(np.array([1]), np.array([38]))).argmax(1)[1:-1]
    local, steps = field.islands(unary, real)
    some = np.concatenate(steps)
    labels = np.zeros(40, int)
    labels[some] = field.beliefs(local, steps)[some].argmax(1)
    assert list(labels[1:-1]) == list(whole) and len(some) < 38


def test_skip_edges_meet_repeats_and_slips():
    assert skip_edges([(0, "Kaktup"), (3, "Kaktupp"), (9, "KAKTUP"), (12, "Zonlep")]) == [(0, 3), (0, 9)]
    many = [(2 * k, f"Name{k:04d}x") for k in range(600)] + [(2000, "Name0007x")]
    assert (14, 2000) in skip_edges(many)


def family(rng):
    return "".join(rng.choice(["kak", "tup", "zon", "lep", "fir", "mod", "gub", "rel"]) for _ in range(2)).capitalize()


SAYS = ["the pump was replaced by {n} with few remarks", "please ask {n} about the lane", "{n} lives at the part of the lane", "signed by {n} on the last page", "the order of {n} was replaced", "for access call {n} or use the pump"]
PLAIN = ["the Sokix pump was replaced with a few remarks", "part number 282-563-A is best", "use the Iris burner with the Vihum Pro", "the order reference 493-582-479 applies to the lane", "a discussion of the Doron part was best", "The pump. Remarks of the residents"]


def test_the_field_and_its_skip_edges_are_needed():
    """On texts whose given names no list has and that say a family name again, cues alone and the field without skip edges find less."""
    rng = Random(11)
    givens = ["Gustav", "Patricia", "Kenji", "Amina", "Robert", "Susan", "Mr Paul", "Dr Laura", "Emma", "Felix", "Hedda", "Irene", "Lars", "Nina", "Noor", "Bram"]
    texts = [rng.choice(SAYS).format(n=f"{rng.choice(givens)} {family(rng)}") + ". " + rng.choice(PLAIN) for _ in range(700)] + [rng.choice(PLAIN) + ". " + rng.choice(PLAIN) + f" {n}" for n in range(700)]
    vocabulary, field = fit_sample(texts, [None] * len(texts), [spans(t, KNOWN) for t in texts], KNOWN)
    held, truth = [], []
    for _ in range(120):
        name = f"{rng.choice(['Oluwaseun', 'Ngozi', 'Tadeusz', 'Wiremu', 'Gustav', 'Noor'])} {family(rng)}"
        text = rng.choice(SAYS).format(n=name) + f". the remarks of the residents and {name.split()[1]} may applies"
        held.append(text)
        truth.append(2 + 1)
    words = lambda found: [sum(len(pii._LETTERS.findall(t[a:z])) for a, z, k in own if k == "name") for t, own in zip(held, found)]
    score = lambda found: sum(min(a, b) for a, b in zip(words(found), truth)) / sum(truth)
    whole = score(entities(held, [None] * len(held), Reader(KNOWN, vocabulary), field))
    apart = score(entities(held, [None] * len(held), Reader(KNOWN, vocabulary), SkipChainField(field.tables, field.chain, field.skip * 0)))
    cues = score([spans(t, KNOWN) for t in held])
    assert whole > apart + 0.1 and whole > cues + 0.1 and whole > 0.85, (whole, apart, cues)
    plain = [rng.choice(PLAIN) + ". " + rng.choice(PLAIN) for _ in range(100)]
    assert sum(map(len, entities(plain, [None] * 100, Reader(KNOWN, vocabulary), field))) <= 2


def test_whole_tables(spark):
    says = ["The pump was replaced by Mr Kaktup with few remarks.", "Signed by Leonard Tupgot, +1-437-555-0102, on the last page.", "Contact: fred@example.org for the pump", "the pump was replaced at 17 Quarry Bank Terrace", "ID on file: social security no. 666 81 3833", "the pump was replaced"]
    rows = [(f"c{n}", f"{says[n % 6]} x{n}", "x", 1) for n in range(120)] + [("c0", f"{says[0]} x0", "x", 1), ("n", None, "x", 1), ("b", "  ", "x", 1), (None, says[0], "x", 1)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, kind string, entities int")
    quarantine = spark.createDataFrame([(7, "Signed by Leonard Ridkoz, on the last page. x", "z"), (8, None, "z")], "id long, reason string, place string")
    texts = texts_of(chunks, quarantine)
    got = {}
    for r in personal_kinds(texts).collect():
        got.setdefault((r["place"], r["row_key"]), set()).add(r["kind"])
    want = [{"name"}, {"name", "phone"}, {"email"}, {"address"}, {"id_number"}, None]
    assert [got.get(("chunks", f"c{n}")) for n in range(6)] == want and got[("quarantine", "7")] == {"name"} and ("chunks", "c5") not in got
    masked = {r["row_key"]: r["text"] for r in redact(texts).collect()}
    assert masked["c0"] == "The pump was replaced by [NAME] with few remarks. x0" and masked["c2"] == "Contact: [EMAIL] for the pump x2" and masked["c3"] == "the pump was replaced at [ADDRESS] x3"
    assert find_personal(texts.limit(0)).count() == 0
    assert mask_text("ab cd", [(3, 5, "name"), (0, 2, "phone"), (1, 2, "name")]) == "[PHONE] [NAME]"


def test_rarer_everyday_words_are_joined(spark, monkeypatch):
    texts = spark.createDataFrame([("chunks", f"k{n}", "the pump and the valve are quite old") for n in range(6)] + [("chunks", "z", "Valve Pump")], "place string, row_key string, text string")
    monkeypatch.setattr(pii, "KNOWN", 3)
    frequent, rare = pii.everyday_words(texts)
    assert len(frequent) == 3 and rare.count() == 4
    own = {r["row_key"]: set(r["rare_words"] or ()) for r in pii.with_rare_words(texts, frequent, rare).collect()}
    assert own["k0"] | frequent >= {"pump", "valve", "quite", "old"} and own["z"] <= {"pump", "valve"} and own["z"] | frequent >= {"pump", "valve"}
