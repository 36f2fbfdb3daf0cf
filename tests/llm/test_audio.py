import numpy as np
from pyspark.sql import functions as F

from wharfline.llm import audio


def prints(tunes):
    limits = audio.thresholds()
    return [audio.fingerprint(audio.resample(*audio.read_wav(audio.write_wav(t))), limits) for t in tunes]


def near(a, b):
    """The link relation: whole fingerprints, at every offset where two filed integers agree."""
    for i in audio.filed_places(a):
        for j in audio.filed_places(b):
            if a[i] == b[j]:
                error, n = audio.bit_error(a, b, int(i - j))
                if n >= max(audio.MIN_OVERLAP, audio.SHARE * min((a != 0).sum(), (b != 0).sum())) and error <= audio.MAX_ERROR:
                    return True
    return False


def test_same_tune_aligns_and_others_do_not():
    rng = np.random.default_rng(2)
    values = [rng.normal(0, 0.13, 64) for _ in range(6)]
    a, b = prints([audio.tune(v, 1) for v in values]), prints([audio.tune(v, 2) for v in values])
    for i in range(6):
        offset, equal, error = audio.align(a[i], b[i])
        assert equal >= 3 and error < 0.1 and near(a[i], b[i])
        assert not near(a[i], b[(i + 1) % 6])


def test_rate_and_layout():
    rng = np.random.default_rng(3)
    x = audio.tune(rng.normal(0, 0.13, 64), 5)
    twice = np.repeat(x, 2)
    assert audio.align(audio.fingerprint(x, audio.thresholds()), audio.fingerprint(audio.resample(twice, 8000), audio.thresholds()))[2] < 0.15
    assert audio.read_wav(b"junk") is None and audio.read_wav(None) is None and audio.read_wav(b"") is None
    assert not audio.fingerprint(np.zeros(20000), audio.thresholds()).any()


def test_recordings_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for v in range(8):
        values = rng.normal(0, 0.13, 64)
        rows += [(len(rows) + s, bytearray(audio.write_wav(audio.tune(values, 10 * v + s)))) for s in range(1 + v % 4)]
    rows += [(90, bytearray(audio.write_wav(np.zeros(9000)))), (91, None), (92, bytearray(b"no audio")), (None, rows[0][1]), (rows[1][0], rows[1][1])]
    df = spark.createDataFrame(rows, "rec long, wav binary").withColumn("codes", F.lit(1)).withColumn("id", F.lit("x"))
    got = audio.recordings(df, "rec", "wav").collect()
    assert len(got) == len(rows)
    known = [(i, audio.fingerprint(audio.resample(*x), audio.thresholds())) for i, x in ((r[0], audio.read_wav(bytes(r[1]) if r[1] else None)) for r in rows) if i is not None and x]
    root = {i: i for i, _ in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            if near(a, b) or (a.tobytes() == b.tobytes() and len(a)):
                root[max(find(i), find(j))] = min(find(i), find(j))
    by = {r.rec: r.class_id for r in got if r.rec is not None}
    assert by == {i: find(i) if i in root else i for i in by}
    assert next(r.class_id for r in got if r.rec is None) == find(rows[0][0])
    assert audio.recordings(df.where("false"), "rec", "wav").count() == 0


def test_split_integer_loses_nothing(spark):
    rng = np.random.default_rng(9)
    values = rng.normal(0, 0.13, 64)
    codes = prints([audio.tune(values, s) for s in range(24)])
    nodes = spark.createDataFrame([(i, bytearray(c.astype("<u4").tobytes())) for i, c in enumerate(codes)], "node long, codes binary")
    root = list(range(24))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in audio.links(nodes, block=4).collect():
        assert near(codes[r.src], codes[r.dst])
        root[find(r.src)] = find(r.dst)
    assert len({find(i) for i in range(24)}) == 1


def plain_votes(a, b):
    return {o: n for o in range(1 - len(b), len(a)) if (n := sum(0 <= i + o < len(a) and a[i + o] == b[i] != 0 for i in range(len(b))))}


def test_offset_votes_against_all_pairs():
    rng = np.random.default_rng(5)
    for kinds, n, m in ((2, 300, 200), (5, 60, 90), (400, 500, 300), (1, 400, 400), (3, 1, 7)):
        a, b = (rng.integers(0, kinds + 1, k).astype(np.uint32) for k in (n, m))
        votes = audio.offset_votes(a, b)
        assert {int(o) - (m - 1): int(v) for o, v in enumerate(votes) if v} == plain_votes(a, b)
    assert audio.align(np.empty(0, np.uint32), np.ones(3, np.uint32)) == (0, 0, 1.0)


def test_an_hour_of_one_tone():
    """Equal integers at every place: in time and memory, not the square of the length."""
    import resource

    n = 3600 * audio.RATE // audio.HOP
    steady = np.full(n, 0xDEADBEEF, np.uint32)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert audio.align(steady, steady) == (0, n, 0.0)
    mixed = np.tile(np.array([1, 2, 3, 4], np.uint32), n // 4)
    assert audio.align(mixed[2:], mixed)[1:] == (len(mixed) - 2, 0.0)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    assert len(audio.filed_places(steady)) == 2


def test_24_bit_wav():
    import io
    import wave

    x = audio.tune(np.random.default_rng(6).normal(0, 0.13, 64), 3)
    whole = np.round(np.clip(x, -1, 1) * (2**23 - 1)).astype("<i4")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(3)
        w.setframerate(audio.RATE)
        w.writeframes(np.repeat(whole, 2).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes())
    got, rate = audio.read_wav(out.getvalue())
    assert rate == audio.RATE and np.allclose(got, np.clip(x, -1, 1), atol=1e-6)
    assert audio.align(audio.fingerprint(got, audio.thresholds()), audio.fingerprint(x, audio.thresholds()))[2] < 0.05


def test_a_shared_jingle_links_nothing(spark):
    rng = np.random.default_rng(7)
    jingle = audio.tune(rng.normal(0, 0.13, 40), 1)
    rows = [(i, np.concatenate((jingle, audio.tune(rng.normal(0, 0.13, 160), 50 + i)))) for i in range(5)]
    rows.append((9, np.concatenate((rows[2][1], rng.normal(0, 0.002, 3000)))))  # the third again
    codes = dict(zip([i for i, _ in rows], prints([x for _, x in rows]), strict=True))
    shared = [(i, j) for i in codes for j in codes if i < j and set(codes[i][codes[i] != 0].tolist()) & set(codes[j][codes[j] != 0].tolist())]
    assert len(shared) >= 10  # the jingle's integers meet
    df = spark.createDataFrame([(i, bytearray(audio.write_wav(x))) for i, x in rows], "rec long, wav binary")
    assert {r.rec: r.class_id for r in audio.recordings(df, "rec", "wav").collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 9: 2}
