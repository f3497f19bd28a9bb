"""Matches that carry their place in the source, against a plain normaliser that works a unit at a time."""

import random
import unicodedata

import pytest
from quire.functions.expressions import FormError
from quire.operators import aligned

NFKC, NFC = (lambda s: unicodedata.normalize("NFKC", s)), (lambda s: unicodedata.normalize("NFC", s))
ODD = ['a', 'b', 'I', 'i', '\u0131', '\u0130', '\ufb01', '\ufb03', 'e', '\xe9', 'e\u0301', '\u0301', '\u0327', '\u1e09', '\xad', '-', '\u2010', '_', '1', '\xbd', '\uff21', '\u03c2', '\u03a3', '\u017f', ' ', ' ', '\xa0', '\t', '\n', '-\n', '\xad\n', 'x', '\xdf', 'q\u0301', '\uac00', '\u1100\u1161']


def is_mark(c):
    return unicodedata.category(c).startswith("M")


def fold(c):
    return {"I": "<I>", "\u0130": "i", "\u03c2": "\u03c3", "\u017f": "s"}.get(c) or c.lower()


def plain_units(text, match_case):
    """[(tokens, start, stop, reads)], by lines, words and characters."""
    tokens = lambda s: [c if match_case else fold(c) for c in NFKC(s)]
    units, at, last_line = [], 0, None
    for number, line in enumerate(text.split("\n")):
        k, words = 0, []
        while k < len(line):
            if line[k] in " \t\r\f\u00a0":
                k += 1
                continue
            stop = k
            while stop < len(line) and line[stop] not in " \t\r\f\u00a0":
                stop += 1
            words.append((k, stop))
            k = stop
        for w, (a, b) in enumerate(words):
            if units:
                if w == 0 and last_line != number and text[units[-1][1]] in "-\u2010\u00ad":
                    if unicodedata.category(line[a]) == "Ll":
                        units[-1] = ([], units[-1][1], units[-1][2], "")
                else:
                    units.append(([" "], units[-1][2], at + a, " "))
            base = None
            for j in range(a, b):
                c = line[j]
                own = [] if c == "\u00ad" else tokens(c)
                if is_mark(c):
                    if base is not None and len(NFC(base[1] + c)) == len(base[1]):
                        base[1] = NFC(base[1] + c)
                        u = units[base[0]]
                        units[base[0]] = (tokens(base[1]), u[1], u[2], u[3])
                        own = []
                else:
                    base = None if c == "\u00ad" else [len(units), NFC(c)]
                units.append((own, at + j, at + j + 1, "" if c == "\u00ad" else c))
            last_line = number
        at += len(line) + 1
    return units


def same(a, b):
    return a == b or {a, b} in ({"<I>", "i"}, {"<I>", "\u0131"})


def in_word(t):
    t = "I" if t == "<I>" else t
    return t == "_" or unicodedata.category(t)[0] in "LNM"


def plain_matches(text, needle, match_case, whole_word):
    needle = [c if match_case else fold(c) for c in " ".join(NFKC(needle).split())]
    units = plain_units(text, match_case)
    line = [(t, k, j == 0) for k, u in enumerate(units) for j, t in enumerate(u[0])]
    at, out = 0, []
    while needle and at + len(needle) <= len(line):
        stop = at + len(needle)
        hit = all(same(n, line[at + j][0]) for j, n in enumerate(needle))
        if hit and whole_word:
            hit = not (at > 0 and in_word(line[at - 1][0])) and not (stop < len(line) and in_word(line[stop][0]))
        if not hit:
            at += 1
            continue
        whole = line[at][2] and (stop == len(line) or line[stop][2])
        first, last = line[at][1], line[stop - 1][1]
        while whole and last + 1 < len(units) and is_mark(text[units[last + 1][1]]):
            last += 1
        out.append((units[first][1], units[last][2], whole, "".join(u[3] for u in units[first : last + 1])))
        at = stop if whole else at + 1
    return out


def test_matches_equal_a_plain_search(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(40))) for _ in range(1500)]
    needles = ["i", "I", "\u0131", "f", "fi", "\u00e9", "e", "a", "ab", "a b", "x-i", "SS", "\u0130", "s", "\u0301", "e\u0301", "\uac00", "\ufb01", "1\u20442", " a ", "", "\u03c3"]
    seen = set()
    for k, text in enumerate(texts):
        for needle in needles:
            case, whole = bool(k % 2), bool(k % 3)
            got = [tuple(m) for m in aligned.matches(text, needle, case, whole)]
            assert got == plain_matches(text, needle, case, whole), (text, needle, case, whole)
            seen |= {(m[2], whole) for m in got}
    assert {(True, True), (True, False), (False, False)} <= seen
    df = spark.createDataFrame([(k, k % 7, t) for k, t in enumerate(texts)] + [(9999, 0, None)], "doc_id long, block int, text string")
    got = {tuple(r) for r in aligned.aligned_matches(df, ["doc_id", "block"], "fi").collect()}
    assert got == {(k, k % 7, *m) for k, t in enumerate(texts) for m in plain_matches(t, "fi", False, False)}
    rows = {r.doc_id: (r.folded, r.sources) for r in aligned.folded_blocks(df, ["doc_id"]).collect()}
    for k, t in enumerate(texts):
        units = plain_units(t, False)
        assert rows[k] == ("".join(x.replace("<I>", "I") for u in units for x in u[0]), [u[1] for u in units for _ in u[0]])
    assert rows[9999] == ("", [])


def test_hand_cases():
    found = lambda *a, **k: [tuple(m)[:3] for m in aligned.matches(*a, **k)]
    assert found("the self-ref-\nerential type", "self-referential") == [(4, 22, True)]
    assert found("co-\u00ad\nop soft\u00adware", "software") == [(8, 17, True)]
    assert found("a \ufb01eld of \ufb01gs", "ield") == [(2, 6, False)] and found("a \ufb01eld", "field") == [(2, 6, True)]
    assert found("cafe\u0301 cafe", "caf\u00e9") == [(0, 5, True)] and found("cafe\u0301", "cafe") == []
    assert found("q\u0301x", "q") == [(0, 2, True)]  # an accent that makes no letter goes along
    assert found("SIK s\u0131k sik", "SIK") == [(0, 3, True), (4, 7, True), (8, 11, True)] and found("s\u0131k", "sik") == []
    assert found("cat concat cat_ cat", "cat", whole_word=True) == [(0, 3, True), (16, 19, True)]
    assert found("New\nYork  New   York", "new york") == [(0, 8, True), (10, 20, True)]


def test_replace_report(spark):
    rows = [(1, 0, True, "istanbul \u0130stanbul ISTANBUL"), (1, 1, False, "istanbul"), (1, 2, True, "Is\u00adtanbul x"), (2, 0, True, "nothing"), (3, 0, True, None)]
    df = spark.createDataFrame(rows, "doc_id long, page int, editable boolean, text string")
    got = [tuple(r) for r in aligned.replace_report(df, ["doc_id"], "istanbul", "\u0130stanbul").collect()]
    assert got == [(1, 5, 3, 1, 1, [0, 2], [1])]
    ligature = spark.createDataFrame([(1, 4, True, "\ufb01eld field")], df.schema)
    assert [tuple(r) for r in aligned.replace_report(ligature, ["doc_id"], "ield", "x").collect()] == [(1, 2, 1, 1, 0, [4], [4])]
    with pytest.raises(FormError):
        aligned.replace_report(df, ["doc_id"], "a", "b\u200b")
    assert aligned.replace_report(df, ["doc_id"], "istanbul", "a\u00a0b\tc").count() == 1
