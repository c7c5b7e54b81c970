"""Personal data: base patterns against plain regular expressions, and disguises with their places."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loreseek.llm import pii
from loreseek.llm.pii import KINDS, all_spans
from tests.llm.conftest import edge_rows, prose


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def naive(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("a.@-1 4+()%é", max_size=60), st.text("0123456789.- +", max_size=60), st.text("ab@.-", max_size=40)))
def test_base_spans(text):
    assert pii.base_spans(text) == naive(text)


@pytest.mark.parametrize(
    "text",
    [
        "mail a.b@c.de, x@y.z@w.v a@b@c.d @b.c@d.e a@b. a@-.-",
        "1.2.3.4.5.6.7.8 256.1.1.1 0256.1.1.1 001.002.003.004 1.2.3 12.34.56.78.",
        "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111112 12345",
        "+49 (30) 1234-5678 +1 2 +1234567890123456 ++49301234567 +49 30 123.",
        "+1 650 253 0000 4111 1111 1111 1111",
    ],
)
def test_base_cases(text):
    assert pii.base_spans(text) == naive(text)


DISGUISED = [
    ("write to jane [at] example [dot] org now", "email", "jane [at] example [dot] org"),
    ("write to jane(at)example(dot)org now", "email", "jane(at)example(dot)org"),
    ("write to jane at example dot org.", "email", "jane at example dot org"),
    ("write to jane at mail dot example dot org.", "email", "jane at mail dot example dot org"),
    ("write to jane@example dot org.", "email", "jane@example dot org"),
    ("mail jаne@exаmple.org please", "email", "jаne@exаmple.org"),
    ("mail jane@​example.org please", "email", "jane@​example.org"),
    ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｏｒｇ", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｏｒｇ"),
    ("host １９２.168.0.1 is down", "ip", "１９２.168.0.1"),
    ("host 192[dot]168[dot]0[dot]1 is down", "ip", "192[dot]168[dot]0[dot]1"),
    ("card ４111 1111 1111 1111 used", "card", "４111 1111 1111 1111"),
    ("card 4111‑1111‑1111‑1111 used", "card", "4111‑1111‑1111‑1111"),
    ("call plus four nine three zero one two three four five six seven today", "phone", "plus four nine three zero one two three four five six seven"),
    ("card four one one one one one one one one one one one one one one one used", "card", "four one one one one one one one one one one one one one one one"),
    ("ruf plus vier neun drei null eins zwei drei vier fünf sechs sieben an", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs sieben"),
]


@pytest.mark.parametrize(("text", "kind", "found"), DISGUISED)
@pytest.mark.parametrize("before", ["", "😀 日本 ", "jane@example.com and "])
def test_disguises_map_back_to_their_places(before, text, kind, found):
    whole = before + text
    base, every = pii.all_spans(whole)
    assert base == naive(whole)
    new = [s for s in every if s not in base]
    assert [(pii.KINDS[k], whole[a:b]) for a, k, b in new] == [(kind, found)]


@pytest.mark.parametrize("text", [prose(400, 3), "We met at noon. The dot was red.", "look at the dot at the end", "look at example.org", "one two three", "Привет, мир 日本", "version 1.2.3 at 10.30"])
def test_clean_texts_have_no_spans(text):
    assert pii.all_spans(text) == ([], [])


@settings(max_examples=200, deadline=None)
@given(st.text("ab1 @.[]()dotａｂ１​а", max_size=80))
def test_base_spans_stay(text):
    base, every = pii.all_spans(text)
    assert base == naive(text) and set(base) <= set(every) and all(0 <= a < b <= len(text) for a, _, b in every)


def test_query(edges, nothing):
    rows = pii.find_personal_data(edges).collect()
    assert len(rows) == len(edge_rows())
    texts = {r[0]: r[1] or "" for r in edge_rows() if r[0] is not None}
    for r in rows:
        if r["doc_id"] is not None:
            spans = naive(texts[r["doc_id"]])
            assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(x[1] == k for x in spans) for k in range(4))
            assert r["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
    assert next(r for r in rows if r["doc_id"] == 6)["n_card"] >= 1
    assert pii.find_personal_data(nothing).count() == 0


def test_masking(edges, make_docs):
    assert pii.mask("a jane@example.org b 10.0.0.1 c jane [at] example [dot] org.") == "a <EMAIL> b <IP> c <EMAIL>."
    masked = pii.masked(edges)
    assert masked.columns == edges.columns and masked.count() == len(edge_rows())
    by_id = {r["doc_id"]: r for r in masked.collect()}
    assert by_id[2]["text"] is None and by_id[1]["text"] == prose(60, 1) and by_id[1]["n_chars"] == len(prose(60, 1))
    assert by_id[1]["h"] == "clash"
    other = make_docs([(1, "x@y.zz", "en", "a", 0)]).selectExpr("text", "doc_id", "'many' as n_chars")
    assert pii.masked(other).first() == ("<EMAIL>", 1, "many")


def test_time_is_linear():
    for text in ("a" * 300_000 + "@", "1." * 150_000, "+1" + "(" * 300_000, "1 " * 150_000, "[at]" * 80_000, "one " * 80_000, "a at " * 60_000, "　" * 300_000, "@a" * 100_000):
        pii.all_spans(text)


ADDRESSES = [
    *((f"write to jane at example dot {end} now", f"jane at example dot {end}") for end in ("it", "pl", "se", "ru", "jp", "museum")),
    ("write to jane@example dot se now", "jane@example dot se"),
    ("write to john dot smith at example dot com.", "john dot smith at example dot com"),
    ("write to john dot q dot smith@example dot com.", "john dot q dot smith@example dot com"),
]


@pytest.mark.parametrize(("text", "found"), ADDRESSES)
def test_plain_signs_of_whole_addresses(text, found):
    base, every = pii.all_spans(text)
    assert not base and [(pii.KINDS[k], text[a:b]) for a, k, b in every] == [("email", found)]
    assert pii.mask(text) == text.replace(found, "<EMAIL>")


def test_plain_at_before_a_written_domain():
    text = "a@b.org or jane at mail.example.org"
    assert pii.mask(text) == "<EMAIL> or <EMAIL>"
    for prose_text in ("a@b.org, we stare at the dot on the page", "point at each dot and count", "be there at 10.30 or a@b.org"):
        assert len(pii.all_spans(prose_text)[1]) == prose_text.count("@")
    for text in ("a dot " * 60_000, "a dot " * 60_000 + "at b dot com", "x at 1 dot " * 30_000, "@1 dot 1" * 40_000):
        pii.all_spans(text)


PARTLY_SPELLED = [
    ("phone", "+49 30 one two three four five six"),
    ("phone", "+1 650 five five five one two three"),
    ("phone", "plus 49 30 one two three four five six"),
    ("phone", "+one six five zero 253 0000"),
    ("phone", "+49 (drei null) 123 four five 67"),
    ("card", "4111 1111 1111 one one one one"),
    ("card", "four one one one, 1111-1111 1111"),
    ("ip", "one nine two dot one six eight dot zero dot one"),
    ("ip", "192.168.zero.one"),
    ("ip", "one zero [dot] 0 [dot] zero [dot] seven"),
    ("ip", "192 dot 168 dot 0 dot 1"),
]


@pytest.mark.parametrize(("kind", "found"), PARTLY_SPELLED)
def test_spelled_digits_within_partly_numeric_identifiers(kind, found):
    text = f"it is {found} here"
    base, every = pii.all_spans(text)
    assert not base and [(pii.KINDS[k], text[a:b]) for a, k, b in every] == [(kind, found)]


def test_spelled_numbers_of_prose():
    for text in ("one, two. three. four. five", "in 2019 one of the two, 10 to one", "one 4 two 5 three 6 four 7 five 8 six 9", "point one two three", "someone four wonder"):
        assert pii.all_spans(text) == ([], [])
    for text in ("one 1 " * 40_000, "plus " * 60_000, "one dot " * 40_000, "1 dot " * 40_000, "+" * 100_000, "one(" * 60_000):
        pii.all_spans(text)


@pytest.mark.parametrize("found", ["jane at example dot\ncom", "jane at example\tdot\tcom", "jane\nat example\r\ndot com", "jane at example  dot  com"])
def test_signs_between_any_white_space(found):
    assert pii.mask(f"write to {found} now") == "write to <EMAIL> now"


def planted(seed: int) -> list[tuple[str, str, str]]:
    """(kind, disguised identifier, text around it) of many forms, with varied names and numbers."""
    rng = random.Random(seed)
    words = "zero one two three four five six seven eight nine".split()
    spell = lambda digits: " ".join(words[int(d)] for d in digits)
    out = []
    for _ in range(12):
        user, host, end = rng.choice(["jane", "j.doe", "bob42", "ann_lee"]), rng.choice(["example", "mail-host", "uni3"]), rng.choice(["com", "pl", "org", "se", "museum"])
        for form in ("{u} at {h} dot {e}", "{u} AT {h} DOT {e}", "{u} [at] {h} [dot] {e}", "{u}(at){h}(dot){e}", "{u}[@]{h}[.]{e}", "{u} {{at}} mail {{dot}} {h} {{dot}} {e}", "{u}@{h} dot {e}", "{u} at\n{h} dot {e}", "{u}&#64;{h}&#46;{e}", "{u}%40{h}.{e}", "{u} @ {h} . {e}", "mail me: {u} at {h}.{e}"):
            found = form.format(u=user, h=host, e=end)
            out.append(("email", found.removeprefix("mail me: "), f"so {found} it is" if not found.startswith("mail") else f"so {found} it is"))
        if "_" not in user and "-" not in host:
            out.append(("email", f"{user}_at_{host}_dot_{end}", f"so {user}_at_{host}_dot_{end} it is"))
        octets = [str(rng.randint(0, 255)) for _ in range(4)]
        out += [("ip", x, f"host {x} is up") for x in (" dot ".join(octets), "[.]".join(octets), "(dot)".join(octets), " dot ".join(map(spell, octets)))]
        body = [rng.randint(0, 9) for _ in range(15)]
        total = sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(body))
        card = "".join(map(str, [*body, -total % 10]))
        groups = [card[k : k + 4] for k in range(0, 16, 4)]
        out += [("card", x, f"paid with {x} today") for x in (spell(card), " ".join([*groups[:3], spell(groups[3])]), card.translate({48 + k: 0xFF10 + k for k in range(10)}), "\u2011".join(groups), "\u200b".join(card))]
        number = str(rng.randint(10**9, 10**10 - 1))
        out += [("phone", x, f"call {x} now") for x in (f"plus four nine {number}", f"+49 {spell(number)}", f"+49 {number[:4]} {spell(number[4:])}", f"plus {spell('49' + number)}", "\uff0b49 " + number)]
    return out


@pytest.mark.parametrize("kind", ["email", "ip", "card", "phone"])
def test_planted_disguises_are_found(kind):
    rows = [(x, text) for k, x, text in planted(5) if k == kind]
    caught = [any(KINDS[k] == kind and text[a:b].strip() == x for a, k, b in all_spans(text)[1]) for x, text in rows]
    assert sum(caught) >= 0.95 * len(rows), [x for (x, _), hit in zip(rows, caught, strict=True) if not hit]


@pytest.mark.parametrize("text", [
    "we met at example.org yesterday", "Look at the dot on the page. Then go.", "meet @ noon. Then leave", "he scored 3 at home . Later 2", "nine of ten at one point four", "at_home_dot_matrix", "rates at 3.5 percent",
    "Arrive at St. Pauls", "one two three four five six", "50% 40% of them", "A&B at 10.30", "see sections (.) and [at] end", "plus one or two at most", "version 1.2.3 at line 4.5", *(prose(400, k) for k in range(30)),
])
def test_clean_texts_are_left_alone(text):
    assert all_spans(text)[1] == []
