import re

from pyspark.sql import functions as F

from wharfline.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d)))
            return 12 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if ok(kind, m.group()))


HARD = [
    "a@b.c x@y z@@w.com a.b@c.d.e@f.g @x.y .@1.2",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.0003.255 1..2.3.4 1.2.3.4567",
    "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 411111111111111 4111  1111 1111 1111",
    "+1 (234) 555-6789 + 1 234 +1-2 +123456789012345 +1234567890123456 +49.30.1234567. ++4930123456",
    "Ünï@x.de é+4930123456é 1.2.3.4é 🙂a@b.co🙂+1 (961) 555-6946",
    "",
    "no digits at all",
]


def test_base_spans_match_the_patterns():
    for t in HARD:
        assert pii.base_spans(t) == plain(t), t


def test_long_texts_are_linear():
    for t in ("1" * 60000, "a@" * 30000, "+" * 60000, "a" * 60000 + "@", "1.2." * 20000):
        pii.all_spans([t], pii.train())


def test_messages_spread_labels():
    model = pii.train()
    text = "call +1 (961) 555-6946 now or later 555-6946 please, order 555-1234 is other"
    (base, added), = pii.all_spans([text], model)
    found = {text[a:z] for a, k, z in added if k == 3}
    assert "555-6946" in found and "555-1234" not in found
    (_, none), = pii.all_spans(["version 2.0.1 of 2024-05-06 has 1234 lines, hash d0be2dc421be4fcd0172e5afceea3970e2f3d940, room 12"], model)
    assert none == []


def test_marginals_exact_on_a_chain():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    x, e, a, s = rng.normal(size=(4, 3)), rng.normal(size=(3, 5)), rng.normal(size=(5, 5)), np.zeros((5, 5))
    chain = np.array([[0, 1], [1, 2], [2, 3]])
    p = pii.marginals(x, chain, np.zeros((0, 2), int), (e, a, s), rounds=60)
    want = np.zeros((4, 5))
    for y in itertools.product(range(5), repeat=4):
        w = np.exp(sum((x @ e)[i, y[i]] for i in range(4)) + sum(a[y[i], y[j]] for i, j in chain))
        for i in range(4):
            want[i, y[i]] += w
    assert np.allclose(p, want / want.sum(axis=1, keepdims=True), atol=1e-6)


def test_held_out_documents():
    """Base spans plus the field against labels known by construction."""
    import random

    rng, hit, truth, wrong = random.Random(99), 0, 0, 0
    model = pii.train()
    for _ in range(150):
        text, spans = pii._example(rng)
        (base, added), = pii.all_spans([text], model)
        got = base + added
        truth += len(spans)
        hit += sum(any(a < z2 and a2 < z for a2, _, z2 in got) for a, _, z in spans)
        wrong += sum(not any(a < z2 and a2 < z for a2, _, z2 in spans) for a, _, z in added)
    assert hit >= 0.97 * truth and wrong <= 0.02 * truth


def test_query_on_edge_rows(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, None), (3, HARD[3]), (90, "x " * 40000 + "a@b.co")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("t", F.lit(1))
    got = pii.find(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert (r.n_email, r.spans) == (0, "")
    assert next(r for r in got if r.doc_id == 90).spans == "email:80000:80006"
    assert pii.find(df.where("false")).count() == 0


def test_whole_table(spark):
    import hashlib

    import pandas as pd

    from wharfline.llm.queries import QUERIES

    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").set_index("doc_id").text
    got = QUERIES["op2_pii"](spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, t in docs.items():
        want = ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in plain(t))
        assert got.base_sha256[i] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got.spans[i].split(","))


def test_fifty_repeats_get_one_label():
    """However many bare repeats there are, and wherever the full mention is."""
    model = pii.train()
    for bare in ("555-6946", "(961) 555-6946"):
        for at in (0, 25, 50):
            parts = [f"later {bare} please"] * 50
            parts.insert(at, "call +1 (961) 555-6946 now")
            text = " ".join(parts) + " order 555-1234 is other"
            (base, added), = pii.all_spans([text], model)
            found = [text[a:z] for a, k, z in added if k == 3]
            assert len(base) == 1 and found.count(bare) == 50 and "555-1234" not in found


#: Written by hand, not by the generator that the field learns from: text, and the personal data in it.
HAND = [
    ("Reach Dr. Alvarez at +1 (617) 555-0142. After six, dial 555-0142 and ask for her.", ["+1 (617) 555-0142", "555-0142"]),
    ("Tel: +1 (303) 555-0199\nFax 555-0100\nOld tel (303) 555-0199, still works.", ["+1 (303) 555-0199", "(303) 555-0199"]),
    ("Office +1 (212) 555-0187; mobile 212-555-0187 -- both are fine. Suite 410, floor 4.", ["+1 (212) 555-0187", "212-555-0187"]),
    ("+1 (415) 555-0123 is the hotline. 415.555.0123 also. In 2023 we had 1200 calls.", ["+1 (415) 555-0123", "415.555.0123"]),
    ("Write to sam.lee24@mail.example.org or ask for sam.lee24 at the desk, ref 88-1234.", ["sam.lee24@mail.example.org", "sam.lee24"]),
    ("The card 4111 1111 1111 1111 was declined on 2024-03-09 at 14:22, lane 3.", ["4111 1111 1111 1111"]),
    ("Items 7 8 9 and then 5500-0000-0000-0004 was charged 120.50 in total.", ["5500-0000-0000-0004"]),
    ("Scores 3 1 4 1 5 9 2 6 5 and 10 20 30 were read out twice: 3 1 4 1 5 9 2 6 5.", []),
    ("Server 192.168.10.7 answered, 192.168.10.300 did not; build 4.18.2 on 8 cores.", ["192.168.10.7"]),
    ("Pages 112-118, ISBN 978-0-306-40615-7, chapter 12, line 4567.", []),
    ("Order 555-0142 shipped in 3 boxes; order 555-0143 is late. Total 1,204.00 EUR.", []),
    ("Commit 9f86d081884c7d65 of 2021-11-30 touches 14 files and 302 lines.", []),
    ("Ring +1 (808) 555-0111 first.\n" + "If busy: 555-0111, again.\n" * 12, ["+1 (808) 555-0111"] + ["555-0111"] * 12),
    ("Row 4111 1111 1111 1111 99 12 of the table; total 34 rows.", ["4111 1111 1111 1111"]),
    ("Numbers: 1 2 3 4 5 6 (702) 555-0177 and on top +1 (702) 555-0177.", ["(702) 555-0177", "+1 (702) 555-0177"]),
    ("Gate 12 at 09:45, seat 31C, booking K7Q2ZP, fare 389.", []),
    ("The years 1914 1918 1939 1945 are carved there, 40 cm high.", []),
    ("Contact: +44 20 7946 0958. Room 20, phone ext 0958, PO box 7946.", ["+44 20 7946 0958"]),
]


def test_precision_and_recall_by_hand():
    """Spans told exactly, of all base and added ones. The figures are in the README."""
    model, hit, truth, told, base_hit = pii.train(), 0, 0, 0, 0
    for (text, want), (base, added) in zip(HAND, pii.all_spans([t for t, _ in HAND], model), strict=True):
        left = list(want)
        for a, _, z in sorted(base + added):
            told += 1
            if text[a:z] in left:
                left.remove(text[a:z])
                hit += 1
        truth += len(want)
        base_hit += sum(text[a:z] in want for a, _, z in base)
    print(f"base {base_hit}, with the field {hit} of {truth}; {told} told")
    assert hit >= 0.9 * truth and hit >= 0.9 * told and hit >= base_hit + 12


def test_number_of_repeats_decides_nothing():
    model = pii.train()
    for bare in ("123-4567", "(555) 123-4567", "555-123-4567"):
        for n in (1, 2, 3, 7, 20, 60):
            text = "Call +1 (555) 123-4567 today. " + f"call {bare} now. " * n
            (base, added), = pii.all_spans([text], model)
            assert [text[a:z] for a, _, z in added] == [bare] * n and len(base) == 1
            (base, added), = pii.all_spans([f"call {bare[-8:]} now. " * n], model)
            assert base == added == []  # nothing tells that it is a phone


def test_spans_end_at_plain_digits():
    model = pii.train()
    for lead in ("1 2 3 4 5 6", "1 2 3 4 5 6 7 8", "1 2 3 4 5 6 7 8 9 1 2 3"):
        text = f"a +1 (555) 123-4567 b {lead} (555) 123-4567 c"
        (_, added), = pii.all_spans([text], model)
        assert added == [(len(text) - 16, 3, len(text) - 2)]


def test_unlike_forms_hear_the_fullest():
    """Many written forms of one number, each once: all follow the full mention, wherever it stands."""
    model, forms = pii.train(), ["(555) 123-4567", "555-123-4567", "555.123.4567", "1 (555) 123-4567", "123-4567", "5551234567"]
    for at in (0, 3, 6):
        parts = [f"try {f}, then" for f in forms]
        parts.insert(at, "+1 (555) 123-4567 is it;")
        text = " ".join(parts)
        (_, added), = pii.all_spans([text], model)
        assert len(added) >= 5 and all(k == 3 for _, k, _ in added)


def test_documents_do_not_change_each_other():
    model = pii.train()
    texts = [t for t, _ in HAND] + HARD
    assert pii.all_spans(texts, model) == [pii.all_spans([t], model)[0] for t in texts]
