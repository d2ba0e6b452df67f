"""Tokenizing, media, language, toxicity and quality, against the library, brute force or held-out rows."""

import hashlib
import zlib
from collections import Counter
from contextlib import nullcontext

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.llm import media
from tideline.llm.language import Profiles, Space, identify_language, learn_profiles
from tideline.llm.pieces import MARK, CheckedWords, Pieces, encode_documents
from tideline.llm.quality import SYMBOLS, robust_outliers, statistics
from tideline.llm.queries import PIECE_MODEL, QUERIES
from tideline.llm.toxicity import Subwords, labelled_rows, learn_toxicity, score_toxicity

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "a", " a  b ", "\t\x0b\x0c\r", "日本語 あ🙂", "▁x ▁▁", "\x00a", "<s> </s> <unk>", "x" * 3000, "née ÉCOLE straße", "a\n\na\n", "#*$%&|<>", "word " * 400]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k0 string, n string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, twice, with null ids, languages and sources and columns of clashing names."""
    rows = [(i if i % 7 else None, t, None if i % 3 else "en", None if i % 2 else "s", 1, "x", "y") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def pieces():
    return Pieces(PIECE_MODEL)


def split_words(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


# --- pieces


TEXTS = st.text(st.one_of(st.sampled_from("abe ▁\n<0x41>é日🙂"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_pieces_equal_the_library(pieces, text):
    ids = pieces.library.encode(text)
    assert pieces.encode(text) == ids
    assert pieces.decode(ids) == pieces.library.decode(ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXTS, max_size=8))
def test_agendas_of_many_words_equal_the_heap_of_each(pieces, texts):
    words = sorted({w for t in texts for w in pieces.split(t)}, key=len)
    flat, ends, odd = pieces.encode_words(words)
    start = 0
    for n, (word, end) in enumerate(zip(words, ends, strict=True)):
        symbols = pieces.join_long(MARK + word.replace(" ", MARK))
        assert flat[start:end] == [i for s in symbols for i in ([pieces.id[s]] if s in pieces.id else pieces.bytes_of(s))]
        assert (n in odd) == (not pieces.plain.issuperset(flat[start:end]))
        start = end
    assert start == len(flat)


def test_encode_documents(spark, odd, nothing, pieces):
    out = encode_documents(odd, PIECE_MODEL, with_ids=True).collect()
    assert len(out) == 2 * len(ODD)
    expected = Counter()
    for i, t in enumerate(ODD):
        ids = pieces.library.encode(t or "")
        expected[i if i % 7 else None, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(pieces.library.decode(ids).encode()).hexdigest(), tuple(ids)] += 2
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in out) == expected
    assert encode_documents(nothing, PIECE_MODEL).isEmpty()
    assert encode_documents(odd, PIECE_MODEL, keep=["n", "k0"]).columns[:2] == ["n", "k0"]
    clash = odd.withColumnRenamed("n", "n_tokens")
    assert encode_documents(clash, PIECE_MODEL, keep=["n_tokens", "k0"]).columns == ["k0", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_a_very_long_text(spark, pieces):
    text = " ".join(["long", "x" * 200_000, "日本" * 5_000, "  ", "end"] * 2)
    out = encode_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), PIECE_MODEL, with_ids=True).first()
    ids = pieces.library.encode(text)
    assert out.ids == ids and out.decoded == pieces.library.decode(ids) and out.n_tokens == len(ids)


def test_words_stay_right_when_the_cache_turns_over(pieces):
    words = CheckedWords(pieces, half=3)
    texts = ["a b c d", "b e f", "a  b\n", "g h  ", " a", "b c d"]
    for t in texts * 2:
        own = pieces.split(t)
        words.learn([own])
        ids = pieces.library.encode(t)
        assert ",".join(words.ids[w] for w in own) == ",".join(map(str, ids)) and words.decoded(own) == pieces.library.decode(ids)


def test_the_library_counts_where_it_differs(pieces, monkeypatch):
    """Both directions are compared: a wrong agenda and a wrong decoder are noticed and made good."""
    for name, wrong in (("join_rows", lambda words: (np.full(len(words), 5, np.int32), np.array([[i, 0] for i in range(len(words))]))), ("spell", lambda ids: " wrong")):
        with monkeypatch.context() as m:
            m.setattr(pieces, name, wrong)
            words = CheckedWords(pieces)
            own = pieces.split("some words \n of  this text  ")
            words.learn([own])
            ids = pieces.library.encode("some words \n of  this text  ")
            assert ",".join(words.ids[w] for w in own) == ",".join(map(str, ids)) and words.decoded(own) == pieces.library.decode(ids)


# --- media


@given(st.binary(max_size=2000))
@settings(deadline=None)
def test_wav_round_trip(payload):
    assert media.decode_wav(media.encode_wav(payload)) == payload


def test_media_digests(spark, odd, nothing):
    out = media.media_digests(odd).collect()
    by_text = {}
    for r in out:
        t = (ODD[r.doc_id] if r.doc_id is not None else None) or ""
        if r.doc_id is not None:
            raw = t.encode()
            padded = raw + b" " * (192 if not raw else -len(raw) % 192)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
            assert by_text.setdefault(t, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert len(out) == 2 * len(ODD) and media.media_digests(nothing).isEmpty()


def test_resampling_keeps_a_tone_and_removes_what_is_too_high():
    n = np.arange(8000)
    low, high = (np.round(100 * np.sin(2 * np.pi * f / media.RATE * n)) for f in (300, 3500))
    y = media.resample(low)
    rate = media.RATE * media.UP / media.DOWN
    assert len(y) == len(low) * media.UP // media.DOWN
    peak = np.argmax(np.abs(np.fft.rfft(y))) * rate / len(y)
    assert abs(peak - 300) < 5
    assert np.abs(media.resample(high)[100:-100]).max() < 0.2 * np.abs(y).max()


def brute_features(samples):
    """The chain again, sample by sample and frame by frame, in Python's integers."""
    taps = media.lowpass()[:, ::-1].T.ravel().astype(int).tolist()  # one filter at UP times the rate
    width = len(taps) // media.UP
    x = [0] * (width // 2) + [b - 128 for b in samples] + [0] * width
    y = []
    for k in range(len(samples) * media.UP // media.DOWN):
        start, phase = divmod(k * media.DOWN, media.UP)
        y.append(sum(x[start + j] * taps[(width - 1 - j) * media.UP + phase] for j in range(width)) // 64)
    if (short := media.FFT - len(y)) > 0 or (short := -(len(y) - media.FFT) % media.STEP):
        y += [0] * short
    bank, (window, turns) = media.filterbank().astype(int), media.transform()
    rows = []
    for at in range(0, len(y) - media.FFT + 1, media.STEP):
        frame = [v * int(w) // 1024 for v, w in zip(y[at : at + media.FFT], window, strict=True)]
        parts = [sum(f * int(t) for f, t in zip(frame, turns[:, b], strict=True)) // 16384 for b in range(turns.shape[1])]
        half = len(parts) // 2
        power = [parts[b] ** 2 + parts[half + b] ** 2 for b in range(half)]
        rows.append([sum(p * int(w) for p, w in zip(power, bank[:, m], strict=True)) for m in range(media.MELS)])
    energy = [sum(v // 16 for v in r) for r in rows]
    middle, spans, open_at, loud = float(np.median(energy)), [], None, False
    for i, e in enumerate([*energy, -1.0]):
        if e >= media.STAY * middle and e >= 0:
            open_at, loud = (i if open_at is None else open_at), loud or e >= media.OPEN * middle
        elif open_at is not None:
            spans += [(open_at, i)] if loud else []
            open_at, loud = None, False
    return rows, spans


@pytest.mark.parametrize("seed", range(4))
def test_features_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    payload = rng.integers(0, 256, 192 * (seed + 1), dtype=np.uint8).tobytes() if seed % 2 else (b"Words of a text, " * 60)[: 192 * (seed + 2)]
    rows, spans = brute_features(payload)
    energy = media.mel_energies(media.resample(np.frombuffer(payload, np.uint8).astype(float) - 128))
    tensors, found, _ = media.features(payload)
    assert energy.astype(int).tolist() == rows and found == spans
    flat = tensors.reshape(-1, media.MELS)[: len(rows)]
    assert np.abs(flat - np.log2(np.array(rows) + 1.0)).max() <= 1 / media.OCTAVE


def test_long_recordings_go_in_blocks():
    payload = np.random.default_rng(1).integers(0, 256, 192 * 4500, dtype=np.uint8).tobytes()
    x = media.resample(np.frombuffer(payload, np.uint8).astype(float) - 128)
    whole, part = media.mel_energies(x), media.mel_energies(x[4000 * media.STEP : 4300 * media.STEP])
    assert len(whole) > 4096 and np.array_equal(whole[4000:4290], part[:290]) and whole.max() < 2**53


@pytest.mark.parametrize("blocks", range(1, 18))
def test_the_end_of_a_recording_is_in_a_frame(blocks):
    payload = b"some words " * (blocks * 192 // 11) + b" " * (blocks * 192 % 11)
    other = payload[:-100] + b"Z" * 100
    (a, _, times), (b, _, _) = media.features(payload), media.features(other)
    hop = media.STEP * media.DOWN / media.UP / media.RATE
    assert times[-1][1] + hop >= len(payload) / media.RATE - 1e-9  # the last frame is two steps long
    assert not np.array_equal(np.round(a, 2), np.round(b, 2))


def test_hysteresis():
    energy = np.array([1, 1, 1, 2, 1, 1, 0.1, 1, 1, 1.0])
    assert media.segments(energy) == [(0, 6)]  # opened at 3, open while above the lower threshold
    assert media.segments(np.ones(5)) == [] and media.segments(np.empty(0)) == []


def test_tensors_have_a_fixed_shape_and_spans(spark, odd):
    rows = media.audio_features(media.text_media(odd.where("doc_id is not null"))).toPandas()
    table = media.tensor_table(pa.Table.from_pandas(rows.assign(tensor=rows.tensor.map(list)), preserve_index=False))
    assert table.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), [media.FRAMES, media.MELS])
    assert (rows.from_s < rows.to_s).all() and rows.active.between(0, 1).all()
    assert rows.groupby("doc_id").part.apply(lambda p: sorted(set(p)) == list(range(max(p) + 1))).all()


def test_media_and_tensors_are_stored_and_read_back(spark, odd, monkeypatch):
    stored = {}
    keep = media.materialize
    monkeypatch.setattr(media, "scratch", lambda spark: nullcontext(lambda table: table))
    monkeypatch.setattr(media, "materialize", lambda df, name, *a: stored.setdefault(name, keep(df, name, *a)))
    out = {r.media_sha256: r.feature for r in media.media_digests(odd).collect()}
    files, tensors = stored["media-wav"].collect(), stored["media-tensors"].collect()
    assert len(files) == len(tensors) == 2 * len(ODD) and {hashlib.sha256(r.media).hexdigest() for r in files} == set(out)
    for r in tensors:
        kind = pa.ipc.open_stream(r.tensors).schema.field("tensor").type
        assert kind == pa.fixed_shape_tensor(pa.float32(), [media.FRAMES, media.MELS])
        values, times = media.unpack_tensors(r.tensors)
        assert len(values) == len(times) and all(a < b for a, b in times) and media.feature_text(r.segments, r.tensors) == out[r.media_sha256]


# --- language


def test_language_on_held_out_rows(spark):
    out = QUERIES["op7_language"](spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    both = out.join(truth, "doc_id").toPandas()
    assert (both.lang_pred == both.lang).mean() > 0.97 and both.score.between(0, 1).all()


def test_language_edges(spark, odd, nothing):
    profiles = Profiles.learn([("the cat and the dog", "en"), ("der hund und die katze", "de")])
    out = {ODD[r.doc_id]: r for r in identify_language(odd.where("doc_id is not null"), profiles).collect()}
    assert out[" "].lang_pred == "und" and out["\n"].lang_pred == "und" and out["a"].lang_pred in ("de", "en")
    assert identify_language(odd, Profiles.learn([])).where("lang_pred <> 'und'").isEmpty()
    assert identify_language(nothing, learn_profiles(nothing)).isEmpty()


def test_every_language_is_learned(spark):
    """Many languages, ties, repeated rows of one id: each value of lang is predicted from its own letters."""
    letters = [chr(0x4E00 + 40 * i) + chr(0x4E01 + 40 * i) + chr(0x4E02 + 40 * i) for i in range(500)]
    rows = [(3 * i + k, (x + " ") * (2 + k), f"l{i:03}") for i, x in enumerate(letters) for k in range(3)] + [(7, letters[2] * 3, "l002")] * 500 + [(None, "no id", "l000"), (9, None, "l003"), (10, "no lang", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = learn_profiles(docs)
    assert set(profiles.languages) == {lang for i, text, lang in rows if i is not None and text and lang and zlib.crc32(str(i).encode()) % 5} and len(profiles.languages) > 450
    out = identify_language(docs.where("doc_id is not null and lang is not null and text is not null"), profiles, keep=["lang", "score"]).where(F.col("lang").isin(profiles.languages))
    assert out.columns == ["lang", "lang_pred", "score"] and out.where("lang <> lang_pred").isEmpty()


def test_equal_cosines_go_to_the_first_language(spark, nothing):
    twin = Profiles.learn([("the cat sat", "zz"), ("the cat sat", "aa")])
    assert identify_language(spark.createDataFrame([(1, "the cat sat")], "doc_id long, text string"), twin).first().lang_pred == "aa"


def test_profiles_do_not_depend_on_order():
    rows = [(f"text {i} of some words {i * 7}", "ab"[i % 2]) for i in range(50)]
    assert np.array_equal(Profiles.learn(rows).prototypes, Profiles.learn(rows[::-1]).prototypes)


def test_bundles_do_not_depend_on_what_was_seen_before():
    a, b = Space(256, 1, most=10), Space(256, 1)
    texts = ["abc def ghi", "xyz uvw", "hello world of letters", "abc"]
    for t in texts * 2:
        assert np.allclose(a.bundle(t), b.bundle(t), atol=1e-5)


# --- toxicity


def test_toxicity_learns_words_and_their_misspellings():
    rng = np.random.default_rng(0)
    filler = ["".join(rng.choice(list("aeioutrnsl"), 5)) for _ in range(300)]
    rows = []
    for i in range(400):
        words = rng.choice(filler, 60).tolist()
        if i % 4 == 0:
            words[rng.integers(60)] = "worthless"
            words[rng.integers(60)] = "disgusting"
        rows.append((" ".join(words), int(i % 4 == 0)))
    model = Subwords().fit(rows[:320])
    margin = model.margins()
    score = lambda text: model.probability([margin(w) for w in text.split()])
    assert np.mean([(score(t) >= 0.5) == y for t, y in rows[320:]]) > 0.95
    plain = " ".join(filler[:200])
    assert score(plain) < 0.5 <= score(plain + " worthlesss disgustingg " + plain)  # seen neither spelling


def test_toxicity_on_held_out_rows(spark):
    """Real labelled rows that were not learned from."""
    folder = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    out = QUERIES["op1_toxicity"](spark, folder).where("held_out").join(truth, "doc_id").toPandas()
    hit = ((out.predicted == 1) & (out.toxic == 1)).sum()
    assert hit >= 0.75 * (out.toxic == 1).sum() and hit >= 0.85 * (out.predicted == 1).sum()


def test_the_sample_is_bounded_by_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, f"{i} " + "x" * (10_000 if i % 10 == 0 else 10)) for i in range(300)] + [(1, "y")] * 1000 + [(2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(1, 1)] * 50 + [(4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = labelled_rows(docs, labels, most_per_class=40)
    assert 0 < sum(y for _, y in rows) <= 40 and sum(1 - y for _, y in rows) <= 40 and len({t for t, _ in rows}) == len(rows)
    few = labelled_rows(docs, labels, most_bytes=2000)
    assert few and all(sum(len(t) for t, y in few if y == k) <= 1000 for k in (0, 1))
    assert {y for t, y in labelled_rows(docs, labels) if t.startswith("4 ")} <= {1}


def test_toxicity_edges(spark, odd, nothing):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, "bad stuff" if i % 2 else "good thing", i) for i in range(40)], "doc_id long, text string, toxic int")
    model = learn_toxicity(docs, labels)
    out = score_toxicity(odd, model).collect()
    assert len(out) == 2 * len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert score_toxicity(docs, model).where("(doc_id % 2 = 1) <> (predicted = 1)").isEmpty()
    assert score_toxicity(nothing, learn_toxicity(nothing, labels.limit(0))).isEmpty()


# --- quality


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#é|"), max_size=120))
def test_statistics_against_brute_force(text):
    words = split_words(text)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if split_words(x)]
    assert statistics(text) == (len(words), sum(map(len, words)), sum(c in SYMBOLS for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


def test_quality_rejects_outliers_only(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(2000)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(60, 300))), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "%%%" for w in rng.choice(words, 100)), "en", "s") for i in range(5)]
    out = robust_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas().set_index("doc_id")
    assert out.kept[out.index < 1000].all() and not out.kept[out.index >= 1000].any() and not out.base_failed.any()


def test_quality_rejects_moderate_outliers(spark):
    """A symbol every second or fourth word; long texts and a rare symbol or repeated line stay."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(2000)]
    text = lambda n, every=0: " ".join(w + " |" * bool(every and i % every == 0) for i, w in enumerate(rng.choice(words, n)))
    rows = [(i, text(int(np.exp(rng.normal(5.6, 0.8))) + 60), "en", "s") for i in range(400)]
    rows += [(500 + i, text(300, 60) + "\nonce more\nonce more", "en", "s") for i in range(5)] + [(600, text(6000), "en", "s")]
    rows += [(1000 + i, text(120 + 40 * i, 2 + 2 * (i % 2)), "en", "s") for i in range(10)]
    out = robust_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas().set_index("doc_id")
    assert not out.base_failed.any() and not out.kept[out.index >= 1000].any()
    assert out.kept[(out.index >= 500) & (out.index < 1000)].all() and out.kept[out.index < 500].mean() > 0.98


def test_quality_judges_groups_of_any_size(spark):
    """A language of thirteen rows, and sources of one row each, beside a large group."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(2000)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(60, 300))), "en" if i < 90 else "xx", "s" if i < 80 else f"own {i}") for i in range(100)]
    rows += [(1000 + i, " ".join(w + "%%%" for w in rng.choice(words, 100)), "xx", "s" if i else None) for i in range(3)]
    out = robust_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas().set_index("doc_id")
    assert len(out) == 103 and out.distance.notna().all()
    assert out.kept[out.index < 1000].mean() > 0.97 and not out.kept[out.index >= 1000].any()


def brute_quality(z):
    """The estimates of all groups in numpy: rows as (own, language, vector)."""
    from tideline.llm import quality as q

    x = np.array([v for *_, v in z])
    above = {}
    members = {}
    for n, (own, of, _) in enumerate(z):
        for fit, parent in ((("own", own), ("of", of)), (("of", of), ("all",)), (("all",), None)):
            above[fit] = parent
            members.setdefault(fit, []).append(n)
    middle = lambda d: np.sort(d, axis=0)[(len(d) + 1) // 2 - 1]

    def sums(at):
        return np.array([len(at), *x[at].sum(0), *(x[at].T @ x[at]).ravel()])

    def merged(own, fit):  # with PRIOR rows like the parent's
        if above[fit] is None:
            return own[fit]
        up = merged(own, above[fit])
        return own[fit] + q.PRIOR * up / up[0]

    def estimate(s, diagonal=False):
        mean, cov = s[1:6] / s[0], s[6:].reshape(5, 5) / s[0]
        cov = cov - np.outer(mean, mean)
        return mean, (np.diag(np.diag(cov)) if diagonal else cov) + np.diag(q.FLOORS)

    distance = lambda at, e: np.einsum("ij,jk,ik->i", x[at] - e[0], np.linalg.inv(e[1]), x[at] - e[0])
    raw = {f: sums(at) for f, at in members.items()}
    plain = {f: middle(x[at]) for f, at in members.items()}

    def center(f):
        if above[f] is None:
            return plain[f]
        n = len(members[f])
        return (n * plain[f] + q.PRIOR * plain[above[f]]) / (n + q.PRIOR)

    starts = [{f: estimate(merged(raw, f), s != 1) for f in members} for s in range(3)]
    starts[2] = {f: (center(f), e[1]) for f, e in starts[2].items()}
    logdet = lambda e: np.linalg.slogdet(e[1])[1]

    def step(now):
        half = {}
        for f, at in members.items():
            d = distance(at, now[f])
            half[f] = sums(np.array(at)[d <= middle(d)])
        return {f: estimate(merged(half, f)) for f in members}

    for _ in range(q.FIRST_STEPS):
        starts = [step(s) for s in starts]
    now = {f: starts[int(np.argmin([logdet(s[f]) for s in starts]))][f] for f in members}
    for _ in range(q.MOST_STEPS - q.FIRST_STEPS):
        now, before = step(now), now
        if max(abs(logdet(now[f]) - logdet(before[f])) for f in members) <= q.STABLE:
            break
    log = {f: np.log(max(0.05, middle(distance(at, now[f])))) for f, at in members.items()}
    out = np.empty(len(z))
    for n, (own, of, _) in enumerate(z):
        a, b = len(members["own", own]), len(members["of", of])
        up = (b * log["of", of] + q.PRIOR * log["all",]) / (b + q.PRIOR)
        out[n] = distance([n], now["own", own])[0] / np.exp((a * log["own", own] + q.PRIOR * up) / (a + q.PRIOR)) * q.CHI2_MEDIAN
    return out


def test_quality_estimate_against_numpy(spark):
    """All groups of real documents, and tiny ones, redone in numpy."""
    from tideline.llm.quality import VECTOR, base_failed, text_statistics, transformed

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 500")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("rare"), F.col("doc_id") % 100)).otherwise(F.substring("source", 1, 4))).dropDuplicates(["doc_id"])
    z = text_statistics(docs, ["doc_id", "lang", "source"]).where(~base_failed()).select("doc_id", "lang", "source", *transformed()).toPandas()
    expected = pd.Series(brute_quality([((r.lang, r.source), r.lang, np.array([r[c] for c in VECTOR])) for _, r in z.iterrows()]), index=z.doc_id)
    got = robust_outliers(docs).toPandas().set_index("doc_id").distance.loc[expected.index]
    assert np.allclose(got, expected, rtol=1e-6)


def test_quality_edges(spark, odd, nothing):
    out = robust_outliers(odd)
    assert out.count() == 2 * len(ODD) and out.where("kept and base_failed").isEmpty()
    assert robust_outliers(nothing).isEmpty()
    alone = robust_outliers(spark.createDataFrame([(1, "word " + " ".join(f"w{i}" for i in range(60)), None, None)], "doc_id long, text string, lang string, source string")).first()
    assert alone.kept and alone.distance == 0
