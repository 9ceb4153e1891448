"""Personal data: the fixed patterns against plain regular expressions, disclosure by hand-made corpora."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from roadgrain.llm import privacy

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    found = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        odd, even = digits[-1::-2], digits[-2::-2]
        if 12 <= len(digits) <= 19 and (sum(odd) + sum(sum(divmod(2 * d, 10)) for d in even)) % 10 == 0:
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    kinds = ("email", "ip", "card", "phone")
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda s: (s[1], kinds.index(s[0]))))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    texts = ["", "a@b.c@d.e", "a@b@c.d x@y.z.", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.4 00256.1.1.1", "+1 (555) 010-9999 +1+22 33 44 55 66"]
    texts += ["".join(rng.choices("ab.@-1234 +()5é\n%_", k=rng.randrange(60))) for _ in range(20_000)]
    texts += ["".join(rng.choices(["4111 1111 1111 1111", "4111111111111112", "1", " ", "-", ".", "12", "+", "x"], k=rng.randrange(12))) for _ in range(5_000)]
    for text in texts:
        assert privacy.joined(privacy.base_spans(text)) == brute_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1" + " " * 300_000, "a@" * 100_000, "1 " * 100_000):
        privacy.base_spans(text)


def corpus():
    """A value that always stands beside one rare name, in other surroundings each time, and plain texts."""
    rows = []
    for i in range(6):
        rows.append((i, f"alpha{'bcdefg'[i]} mister Zorblatt writes jo@mail.example.com omega{'bcdefg'[i]} today"))
    rows += [(10 + i, f"the mister of house {i} writes nothing today") for i in range(60)]
    return rows


def test_terms_that_disclose_a_value_are_found(docs):
    found = {r["doc_id"]: r for r in privacy.find_personal_data(docs(corpus())).collect()}
    text = corpus()[0][1]
    at, mail = text.index("Zorblatt"), text.index("jo@")
    assert found[0]["spans"] == f"term:{at}:{at + 8},email:{mail}:{mail + 19}"
    assert found[0]["base_sha256"] == hashlib.sha256(f"email:{mail}:{mail + 19}".encode()).hexdigest()
    assert found[0]["n_email"] == 1 and found[0]["n_term"] == 1
    assert all(found[i]["spans"] == "" for i in range(10, 70))
    few = privacy.find_personal_data(docs(corpus()[:2] + corpus()[6:])).collect()
    assert sum(r["n_term"] for r in few) == 0  # two surroundings are not enough


def test_exact_copies_are_one_surrounding(docs):
    rows = [(i, "captain Quibbleson calls +1 (555) 010-9999 now") for i in range(30)] + [(100 + i, f"text {i}") for i in range(99)]
    assert sum(r["n_term"] for r in privacy.find_personal_data(docs(rows)).collect()) == 0


def test_every_surrounding_counts_as_evidence(docs):
    plain = [(100 + i, f"the caller of house {i} writes nothing today") for i in range(400)]
    twice = [(i, f"first{'ab'[i]} caller Zorblatt writes jo@mail.example.com last{'ab'[i]} today") for i in range(2)]
    text = twice[0][1]
    at, mail = text.index("Zorblatt"), text.index("jo@")
    found = {r["doc_id"]: r["spans"] for r in privacy.find_personal_data(docs(twice + plain)).collect()}
    assert found[0] == f"term:{at}:{at + 8},email:{mail}:{mail + 19}" and found[1].startswith("term:")
    soft = {r["doc_id"]: r["text"] for r in privacy.remove_personal_data(docs(twice + plain)).collect()}
    assert soft[0] == "firsta caller <NAME> writes <EMAIL> lasta today"
    # Rare words beside a value of one document stay; so does a word that often stands elsewhere.
    once = privacy.find_personal_data(docs(twice[:1] + plain)).collect()
    assert sum(r["n_term"] for r in once) == 0
    elsewhere = [(600 + i, f"Zorblatt number {i}") for i in range(60)]
    assert sum(r["n_term"] for r in privacy.find_personal_data(docs(twice + plain + elsewhere)).collect()) == 0


def test_words_near_a_value_are_whole(docs):
    rows = []
    for i in range(6):
        far = " ".join("pqrstu"[i] * 60 for _ in range(3))
        rows.append((i, f"a{'bcdefg'[i]} Zorblatt {far} {'x' * 200} jo@mail.example.comé {'-' * 200} Quillfeather today"))
    rows += [(10 + i, f"house {i} writes nothing today") for i in range(60)]
    found = {r["doc_id"]: r for r in privacy.find_personal_data(docs(rows)).collect()}
    text = rows[0][1]
    terms = [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in found[0]["spans"].split(",")) if k == "term"]
    assert terms == ["Zorblatt", "x" * 200, "Quillfeather"] and found[5]["n_term"] == 3
    many = "1.2.3.4 " * 100_000 + "end"
    assert privacy.surroundings(privacy.base_spans(many), many)[0] == ["end"]


def test_texts_are_sanitised(docs):
    df = docs([*corpus(), (99, None)])
    clean = privacy.remove_personal_data(df)
    assert clean.columns == df.columns
    found = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert found[0] == "alphab mister  writes <EMAIL> omegab today" and found[99] is None
    soft = {r["doc_id"]: r["text"] for r in privacy.remove_personal_data(df, remove=2.0).collect()}
    assert soft[0] == "alphab mister <NAME> writes <EMAIL> omegab today"


def test_sanitise_overlapping_spans():
    text = "call 4111 1111 1111 1111.2.3.4 end"
    spans = [privacy.Span("card", 5, 24), privacy.Span("ip", 20, 30)]
    assert privacy.sanitise(text, spans) == "call <CARD> end"


def test_odd_rows(odd, empty):
    found = privacy.find_personal_data(odd).collect()
    want = sorted(repr((r["doc_id"], brute_spans_of_odd(r["text"]))) for r in odd.select("doc_id", "text").collect())
    assert sorted(repr((r["doc_id"], r["spans"])) for r in found) == want
    assert privacy.find_personal_data(empty).count() == 0
    assert privacy.remove_personal_data(odd).count() == odd.count()


def brute_spans_of_odd(text):
    # The plain patterns take quadratic time on the one long run of digits.
    return f"email:0:{len(text) - 1}" if text and text.startswith("1" * 100) else brute_spans(text or "")


@pytest.mark.parametrize("digits", ["4111111111111111", "378282246310005", "6011111111111117"])
def test_luhn(digits):
    assert privacy.luhn(digits) and not privacy.luhn(digits[:-1] + str((int(digits[-1]) + 1) % 10))
