import hashlib
import random
import re

from stationgrid.llm import pii


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    pieces = list("0123456789") * 4 + list("..  --()+@@ab%_\n") + ["é", "1.2.3.4", "a@b.c", "+1 (555) 555-1234", "4111 1111 1111 1111"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 60)))
        assert [tuple(s) for s in pii.base_spans(text)] == plain(text), text


def test_unbroken_text_takes_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "@" * 100_000, "1-" * 150_000):
        pii.base_spans(text)
        pii.candidates(text)


def test_documents(documents):
    got = pii.detect(documents).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in got:
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert {"%s:%d:%d" % s for s in base} <= set(r.spans.split(","))


def test_reformatted_data_is_added_and_dates_are_not(table):
    rng = random.Random(6)
    words = "lorem ipsum dolor sit amet consectetur".split()

    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + digits(14)
        return next(body + c for c in "0123456789" if pii.luhn(body + c))

    rows = [(i, f"{' '.join(rng.choices(words, k=20))} user{i}@mail{i % 7}.example.com call +1 ({digits(3)}) 555-{digits(4)} and {card()} at {i % 250}.{i % 9}.7.1 {digits(12)} end") for i in range(300)]
    docs = table(rows)
    detector = pii.train(docs)
    again = pii.train(docs)
    assert detector.thresholds == again.thresholds
    tests = table([(1, "call 988-555-2485 now"), (2, "write joe[at]mail3[dot]example[dot]com"), (3, "on 2021-03-04 12 and version 1.2.3")])
    got = {r.doc_id: r for r in pii.find_personal_data(tests, detector, redact=True).collect()}
    assert got[1].spans == "phone:5:17" and got[1].n_phone == 0 and got[1].redacted == "call [phone] now"
    assert got[2].spans.startswith("email:6:") and got[3].spans == ""


def test_odd_rows(odd, table):
    got = pii.detect(odd).collect()
    assert len(got) == 8 and {r.spans for r in got} == {""} and {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert pii.detect(table([])).collect() == []
