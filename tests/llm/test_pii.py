import hashlib
import random
import re

from assaykit.llm import pii

from .cases import frames

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def brute(text):
    spans = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        odd = d[-1::-2]
        even = [sum(divmod(2 * x, 10)) for x in d[-2::-2]]
        if 14 <= len(d) <= 19 and (sum(odd) + sum(even)) % 10 == 0:
            spans.append((m.start(), 2, m.end()))
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(spans)


def test_base_spans_match_the_patterns():
    rng = random.Random(1)
    parts = ["a@b.c", "x.y%+@z-1.co.uk_d@e.f", "@", "a@", "@b.c", "a@@b.cc", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0000255.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+1 (017) 555-7713", "+1", "+12.34", "é", "\n", " ", "-", ".", "12345678901234567890123", "+49 30 901820 44 ", "p@q.r@s.t"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", ""]) for _ in range(rng.randint(1, 8)))
        assert pii.base_spans(text) == brute(text), text


def crf():
    return pii.Crf().train(pii.read_labelled(pii.LABELLED))


def test_crf_fits_its_table_and_adds_spans():
    model, slots = crf(), pii.Slots()
    table = pii.read_labelled(pii.LABELLED)
    assert model.decode([w for w, _ in table], slots) == [s for _, s in table]
    texts = ["please write to sam dot roe at mail dot example dot com soon", "a plain text with a dot at the end in 1998", "token = \"5e71cd2b7c08d8c9ac\" and version 3.0", "the ip 10 . 0 . 0 . 8 is down"]
    base = [pii.base_spans(t) for t in texts]
    found = pii.added_spans(texts, base, model, slots)
    assert [texts[0][a:b] for a, _, b in found[0]] == ["sam dot roe at mail dot example dot com"]
    assert not found[1] and not found[2]
    assert [texts[3][a:b] for a, _, b in found[3]] == ["10 . 0 . 0 . 8"]


def test_query_rows(spark):
    rows = [(1, "mail a@b.co or +1 (017) 555-7713 from 10.1.2.3 card 4111 1111 1111 1111"), (2, None), (3, "nothing 😀 here@"), (4, "😀 a@b.co")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == ""
    assert got[4].spans == "email:2:8"  # code points
    for i, t in rows:
        want = pii.join_spans(brute(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[i].spans == want


def test_redaction_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co now", "en"), (2, None, "en"), (3, "clean", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got == {1: "mail [email] now", 2: None, 3: "clean"}


def test_awkward_rows(spark):
    docs, none = frames(spark)
    assert pii.personal_data(docs).count() == docs.count() and pii.personal_data(none).count() == 0
    assert pii.redact(none).columns == none.columns
