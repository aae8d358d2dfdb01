import random

import pytest

from quillrock.llm.personal import NameForms, find, learned_forms, luhn, mod97, personal_spans, redacted, replaced

NAMES = [f"{g}{s} {f}{e}" for g in ("Jor", "Sten", "Oril", "Ruv", "Ned", "Piv") for s in ("isk", "elka", "ette", "in", "or", "ava") for f, e in (("Zello", "vik"), ("Yarri", "dale"), ("Ullka", "lan"), ("Rosti", "ner"), ("Kelse", "ska"), ("Dorva", "worth"))]


@pytest.fixture(scope="module")
def forms():
    return NameForms(NAMES)


def kinds(text, forms):
    return [(f.kind, text[f.start : f.end]) for f in find(text, forms)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("mail a.b+x@ect.mail.example, ok", [("email", "a.b+x@ect.mail.example")]),
        ("a.b at mail dot example only", [("email", "a.b at mail dot example")]),
        ("to\n> j.k (at) mail-x.test now", [("email", "j.k (at) mail-x.test")]),
        ("z9[at]y.example", [("email", "z9[at]y.example")]),
        ("a.b @ mail.example", [("email", "a.b @ mail.example")]),
        ("sells for 2 lots @ $1.3 million at Blue Mesa", []),
        ("Ullka, J/WXM/SYS@SYS", []),
        ("call (212) 555-0129.", [("phone", "(212) 555-0129")]),
        ("call +44 (0)20 7946 0139, ok", [("phone", "+44 (0)20 7946 0139")]),
        ("Tel 7135550176", [("phone", "7135550176")]),
        ("+49 30\r\n> 23125 293 for", [("phone", "+49 30\r\n> 23125 293")]),
        ("1-503-555-0158 (office)", [("phone", "1-503-555-0158")]),
        ("Item 798040933, deal 101-10-509, $1,234.50, 2001-05-16", []),
        ("needs 829-27-6039 for", [("id_number", "829-27-6039")]),
        ("SSN 879463997 and", [("id_number", "879463997")]),
        ("000-12-3456 and 912-12-3456", []),
        ("NI no QQ 02 91 11 A and", [("id_number", "QQ 02 91 11 A")]),
        ("QX15 1LD is no number", []),
        ("at 4880 Ostler Rd, Granby, CO 47784", [("street_address", "4880 Ostler Rd")]),
        ("from P.O. Box 129, Carrow", [("street_address", "P.O. Box 129")]),
        ("Birkenstr. 67, 62190 Wexmoor", [("street_address", "Birkenstr. 67")]),
        ("2550 N. Kestrel Blvd., Apt 14C", [("street_address", "2550 N. Kestrel Blvd")]),
        ("Ms. Joristin x Jorisk A. Zellovik left", [("person", "Jorisk A. Zellovik")]),
        ("for ZELLOVIK, JORAVA and", [("person", "ZELLOVIK, JORAVA")]),
        ("E. Kelseska moved", [("person", "E. Kelseska")]),
        ("by nedelka\nyarridale-ullkalan.", [("person", "nedelka\nyarridale-ullkalan")]),
        ("Zellovik and Jorisk said", []),
        # digits confirmed as a card number are no telephone number, refuted ones may be
        ("pay 4111 1111 1111 1111 now", [("card_number", "4111 1111 1111 1111")]),
        ("IBAN GB82 WEST 1234 5698 7654 32.", [("bank_account", "GB82 WEST 1234 5698 7654 32")]),
        ("IBAN GB83 WEST 1234 5698 7654 32.", []),
        # the words before it decide about a number
        ("ticket 829-27-6039 open", []),
        ("deal 713 555 0176 today", []),
        ("cell 713 555 0176 today", [("phone", "713 555 0176")]),
        ("S. Yarridale,\nstenin.yarridale@x.example", [("person", "S. Yarridale"), ("email", "stenin.yarridale@x.example")]),
    ],
)
def test_found(text, want, forms):
    assert kinds(text, forms) == want


def test_checks():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("GB82WEST12345698765432") and not mod97("GB83WEST12345698765432")


def test_redaction(forms):
    t = "Jorisk Zellovik, card 4111 1111 1111 1111, a@b.example"
    assert replaced(t, find(t, forms)) == "[PERSON], card [CARD_NUMBER], [EMAIL]"


def test_operator(spark):
    people = spark.createDataFrame([(n, None) for n in NAMES] + [(None, "t")], "display_name string, body string")
    rows = [(1, None, 0), (2, "", 0), (3, "x\U0001f600 a@b.example", 0), (3, "x\U0001f600 a@b.example", 0), (4, "word " * 200_000 + "a@b.example", 0)]
    m = spark.createDataFrame(rows, "row_id bigint, body string, kind int")
    got = sorted(map(tuple, personal_spans(m, people).collect()))
    assert got == [(3, "email", 3, 14)] * 2 + [(4, "email", 1_000_000, 1_000_011)]
    out = dict(redacted(m, people).where("row_id < 4").distinct().collect())
    assert out == {1: None, 2: "", 3: "x\U0001f600 [EMAIL]"}
    assert personal_spans(m.limit(0), people).count() == 0
    assert personal_spans(m, people.limit(0)).count() == 3


def test_all_names_of_a_long_list(spark):
    """A list of more than 50,000 names: each of them is found, as no family name shares its ending."""

    def word(i):
        return "".join(chr(97 + i // 26**k % 26) for k in range(4))

    names = range(50_400)
    people = spark.createDataFrame([(f"Jo{word(7 * i)} Be{word(i)}",) for i in names], "display_name string")
    rows = spark.createDataFrame([(i, f"asked Jo{word(7 * i)} Be{word(i)} today") for i in names], "row_id bigint, body string")
    found = personal_spans(rows, people)
    assert found.where("kind = 'person' and char_start = 6 and char_end = 19").select("row_id").distinct().count() == found.count() == len(names)


def test_forms_counted_over_a_table(spark):
    """What Spark counts of a table is what is counted of the list, repeated and odd names included."""
    r = random.Random(5)
    syllables = ["an", "bel", "cor", "d\xe9", "el", "fin", "gus", "ho", "\xefr", "\U00010428a", "lo", "ma", "ny", "os"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    for n in (0, 5, 300, 3_000):
        names = [f"{word().title()}{r.choice([' ', ' Q. ', '  '])}{word()}{r.choice(['', '-' + word(), '-x'])}" for _ in range(n)] + ["", "Solo", "1 2", "A B", "Li Wu"]
        want = NameForms(names)
        got = learned_forms(spark.createDataFrame([(x,) for x in names * 2] + [(None,)], "display_name string"))
        assert (got.families, got.endings, got.last) == (want.families, want.endings, want.last)
        assert (got.given.listed, got.given.stems, got.given.tails) == (want.given.listed, want.given.stems, want.given.tails)
    assert want.given.stems and want.endings
