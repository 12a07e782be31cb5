import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, chat_windows, classifier_chain, decision_list, jaccard_join, media, packing, token_files, url_filter, webp, wordpiece

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\t", "one", "a b c d", "a b c d e f", "x" * 3000, "!" * 1500 + " y", "Zürich  it's\u00a0we'll 12345 \u2003 end ", "J\u030c \u0130 \u03a3\u03a3 <|endoftext|>",
    "same text here for all to see and copy", "same text here for all to see and copy", "word " * 2000, "\x00\x1c\x85 mixed\r\nlines\x0b\x0c", "😀 emoji 🏳️‍🌈 flags",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", -1.5) for i, t in enumerate(ODD)] + [(None, "no id", "z", 0.0), (3, ODD[3], "again", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, toxic double")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# ---- 1 chat windows


def chat(spark, turns):
    return spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, block string")


def test_chat_digest_reads_back(spark):
    rng = random.Random(2)
    words = ["a", "<|im_end|>", "<\\|", "<|", "%0A", "\\", "é😀", "\n", "<\\\\|x"]
    turns = [(c, t, rng.choice(["user", "assistant", "system" if t == 0 else "user", "odd\nro%le", None]), None if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randrange(60))), "x") for c in range(30) for t in range(rng.randrange(1, 12))]
    df = chat(spark, turns + [(99, t, "assistant" if t % 2 else "user", f"turn {t}", "x") for t in range(700)])
    windows = chat_windows.chat_windows(df, budget=120, history_tokens=30, history_turns=2, block_turns=64)
    got = {r["conv_id"]: r for r in rows_of(chat_windows.conversation_digest(windows))}
    whole = collections.defaultdict(list)
    for c, t, role, text, _ in sorted(turns, key=lambda r: r[:2]):
        whole[c].append((role or "", text or ""))
    whole[99] = [("assistant" if t % 2 else "user", f"turn {t}") for t in range(700)]
    assert set(got) == set(whole)
    for c, said in whole.items():
        loss = "".join(x for r, x in said if r == "assistant")
        assert got[c]["n_turns"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in rows_of(windows):
        assert w["n_tokens"] <= 120 or w["over_budget"]
        assert w["n_turns"] > w["n_repeated"]
        if w["over_budget"]:
            assert w["n_turns"] - w["n_repeated"] == 1


def test_chat_repeats_system_and_history(spark):
    df = chat(spark, [(1, 0, "system", "S" * 40, "")] + [(1, t, "assistant" if t % 2 == 0 else "user", str(t) * 80, "") for t in range(1, 9)])
    got = sorted(rows_of(chat_windows.chat_windows(df, budget=110, history_tokens=30, history_turns=2, tokens=F.ceil(F.length("text") / 4))), key=lambda w: w["part"])
    assert len(got) > 2
    for w in got[1:]:
        assert w["formatted"].startswith("<|im_start|>system\n") and w["n_repeated"] == 2 and w["formatted"].count("<|im_start|>system") == 1
    assert chat_windows.chat_windows(df.where("false")).count() == 0


def test_chat_budgets(spark):
    said = [(1, 0, "system", "s " * 30, ""), *((1, t, "assistant" if t % 2 == 0 else "user", f"w{t} " * 10, "") for t in range(1, 9))]
    text = F.col("text")
    # Each turn has 10 words (30 the first) and MARK_TOKENS: a budget of 90 holds the system turn and four more.
    windows = chat_windows.chat_windows(chat(spark, said), budget=90, history_tokens=0, history_turns=0, tokens=F.size(F.split(F.trim(text), " ")))
    got = sorted(rows_of(windows), key=lambda w: w["part"])
    assert [(w["n_turns"], w["n_repeated"], w["n_tokens"], w["over_budget"]) for w in got] == [(5, 0, 90, False), (5, 1, 90, False)]
    big = chat_windows.chat_windows(chat(spark, said), budget=20, history_tokens=0, history_turns=0, tokens=F.size(F.split(F.trim(text), " ")))
    got = sorted(rows_of(big), key=lambda w: w["part"])
    assert [(w["n_turns"], w["over_budget"]) for w in got] == [(1, True), *[(2, True)] * 8]
    found = spark.createDataFrame([("Two words, 12 3!\n\n x\u00e9\u0301",), ("",)], "text string").select(chat_windows.piece_tokens(text)).collect()
    assert [r[0] for r in found] == [9, 0]


def test_chat_rows_without_or_with_equal_numbers(spark):
    rows = [(1, None, "user", "late", ""), (1, None, "user", "early", ""), *((1, 5, "assistant", f"a{k:03d}", "") for k in range(400)), (1, 2, None, None, ""), (None, None, None, None, None), (None, 3, "assistant", "z" * 400_000, "")]
    got = {r["conv_id"]: r for r in rows_of(chat_windows.conversation_digest(chat_windows.chat_windows(chat(spark, rows))))}
    whole = "user\nearly\nuser\nlate\n\n\n" + "".join(f"assistant\na{k:03d}\n" for k in range(400))
    assert got[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and got[1]["n_turns"] == 403
    assert (got[None]["n_turns"], got[None]["loss_chars"]) == (2, 400_000)


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="<|\\im_endstar>% \n", max_size=60))
def test_escape_is_undone(text):
    fine = lambda t: re.sub(r"<(\\*)\|", r"<\\\1|", t)
    back = lambda t: re.sub(r"<\\(\\*)\|", r"<\1|", t)
    assert back(fine(text)) == text and "<|" not in fine(text)


# ---- 2 media


def test_webp_all_transforms():
    rng = np.random.default_rng(1)
    for colours in (1, 2, 3, 5, 16, 17, 256):
        grey = rng.integers(0, colours, 192 * 5).astype(np.uint8)
        for palette in (False, True):
            w, h, p = webp.decode_webp(webp.encode_grey(grey, 192, palette))
            assert (w, h) == (192, 5) and (p == np.uint32(0xFF000000) | grey.astype(np.uint32) * np.uint32(0x010101)).all()
    few = rng.integers(0, 1 << 32, 6, dtype=np.uint64).astype(np.uint32)
    for width, height in ((5, 7), (17, 9)):
        for image in (few[rng.integers(0, 6, width * height)], rng.integers(0, 1 << 32, width * height, dtype=np.uint64).astype(np.uint32)):
            for transforms in ((), (0,), (1,), (2,), (0, 1, 2), (1, 0)):
                for repeats in (False, True):
                    for cache in (0, 5):
                        assert (webp.decode_webp(webp.encode_argb(image, width, transforms, repeats=repeats, cache_bits=cache))[2] == image).all()


class Fields:
    """A stream written field by field, least bit first, apart from the encoder."""

    def __init__(self, *fields):
        self.bits = [value >> k & 1 for value, n in fields for k in range(n)]

    def file(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        stream = bytes(sum(bits[k + j] << j for j in range(8)) for k in range(0, len(bits), 8))
        stream += b"\0" * (len(stream) & 1)
        return b"RIFF" + (12 + len(stream)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream


def simple(*symbols):
    """A prefix code of one or two symbols of eight bits."""
    return [(1, 1), (len(symbols) - 1, 1), (1, 1), (symbols[0], 8), *((x, 8) for x in symbols[1:])]


def test_webp_foreign_streams():
    one = webp.decode_webp(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert one[:2] == (1, 1) and len(one[2]) == 1
    head = lambda w, h: [(0x2F, 8), (w - 1, 14), (h - 1, 14), (0, 1), (0, 3)]
    # A code of eleven given lengths: green 7 and 9 have one bit each from a code with one word for length 1.
    rest = [*simple(3), *simple(5), *simple(255)]
    plain = Fields(*head(3, 1), (0, 1), (0, 1), (0, 1), *simple(7, 9), *rest, *simple(0), (0, 1), (1, 1), (1, 1)).file()
    assert [hex(x) for x in webp.decode_webp(plain)[2]] == ["0xff030705", "0xff030905", "0xff030905"]
    # Subtracted green comes back into red and blue.
    green = Fields(*head(2, 1), (1, 1), (2, 2), (0, 1), (0, 1), (0, 1), *simple(7, 9), *rest, *simple(0), (0, 1), (1, 1)).file()
    assert [hex(x) for x in webp.decode_webp(green)[2]] == ["0xff0a070c", "0xff0c090e"]
    # A palette of two colours, eight pixels to a byte: 0b0101 for a row of four.
    palette = Fields(
        *head(4, 1), (1, 1), (3, 2), (1, 8), (0, 1), *simple(10, 20), *simple(0), *simple(0), *simple(255, 0), *simple(0), (0, 1), (1, 1), (1, 1), (0, 1),
        (0, 1), (0, 1), (0, 1), *simple(5), *simple(0), *simple(0), *simple(255), *simple(0),
    ).file()
    assert [hex(x) for x in webp.decode_webp(palette)[2]] == [hex(x) for x in (0xFF001E00, 0xFF000A00, 0xFF001E00, 0xFF000A00)]
    # A predictor tile of mode 1 (left): residuals add up along the row.
    left = Fields(
        *head(3, 1), (1, 1), (0, 2), (0, 3), (0, 1), *simple(1), *simple(0), *simple(0), *simple(255), *simple(0), (0, 1),
        (0, 1), (0, 1), *simple(2, 4), *simple(0), *simple(0), *simple(0), *simple(0), (0, 1), (1, 1), (1, 1),
    ).file()
    assert [hex(x) for x in webp.decode_webp(left)[2]] == ["0xff000200", "0xff000600", "0xff000a00"]


def test_webp_plans_fit_their_content():
    rng = np.random.default_rng(3)
    line = rng.integers(32, 127, 400).astype(np.uint8)
    texts = {
        "palette": rng.choice([48, 49, 50], 192 * 7, p=[0.9, 0.05, 0.05]).astype(np.uint8),
        "mode": (np.cumsum(rng.integers(-2, 3, 192 * 20)) & 255).astype(np.uint8),
        "spans": np.concatenate([line, rng.integers(32, 127, 300).astype(np.uint8), line, line[50:], line[:86]])[: 192 * 8],
    }
    for kind, samples in texts.items():
        samples = samples[: len(samples) // 192 * 192]
        plan = webp.plan_grey(samples, 192)
        assert plan.get(kind), kind
        stored = webp.encode_grey(samples, 192, **plan)
        assert len(stored) < len(webp.encode_grey(samples, 192))
        assert (webp.decode_webp(stored)[2] == np.uint32(0xFF000000) | samples.astype(np.uint32) * np.uint32(0x010101)).all()
    for mode in (1, 2):
        for shape in ((192, 1), (1, 9), (7, 5), (600, 3), (3, 600)):
            image = rng.integers(0, 256, shape[0] * shape[1]).astype(np.uint8)
            assert (webp.decode_webp(webp.encode_grey(image, shape[0], mode=mode))[2] & 255 == image).all()
    many = np.concatenate([np.concatenate([line[:64], rng.integers(32, 127, 20).astype(np.uint8)]) for _ in range(4000)])
    many = many[: len(many) // 192 * 192]
    plan = webp.plan_grey(many, 192)
    assert len(plan["spans"]) > 3000 and (webp.decode_webp(webp.encode_grey(many, 192, **plan))[2] & 255 == many).all()


def test_webp_work_of_a_text():
    """Calls that storing and loading texts takes: what a text costs beside its bytes."""
    import cProfile
    import pstats

    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    payloads = [media.payload_of(" ".join(rng.choice(words) for _ in range(600))) for _ in range(20)]
    media.load(media.store(payloads[0]))
    profile = cProfile.Profile()
    profile.enable()
    back = [media.load(media.store(p))[3] for p in payloads]
    profile.disable()
    assert back == payloads
    assert pstats.Stats(profile).total_calls < 2000 * len(payloads)


def test_far_repeats_leave_none_out():
    """The same repeats as when every place is extended."""
    rng = np.random.default_rng(7)
    for _ in range(60):
        base, parts = rng.integers(97, 100 + int(rng.integers(20)), 4000).astype(np.uint8), []
        for _ in range(60):
            at, n = int(rng.integers(3900)), int(rng.integers(8, 60))
            parts.append(base[at : at + n])
        samples = np.concatenate([base, *parts, base[:64]])
        raw = samples.tobytes()
        windows = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
        first, found, done = {}, [], 0
        for at in np.flatnonzero(windows >> np.uint64(60) == 0).tolist():
            before, back, ahead = first.setdefault(int(windows[at]), at), 0, 0
            if before == at or at < done:
                continue
            while back < min(at - done, before, 256) and raw[at - back - 1] == raw[before - back - 1]:
                back += 1
            while at + ahead < len(raw) and ahead < 4096 - back and raw[at + ahead] == raw[before + ahead]:
                ahead += 1
            if back + ahead >= 32:
                found.append((at - back, back + ahead, at - before))
                done = at + ahead
        assert found and webp.far_repeats(samples) == found


def test_webp_damage_is_an_error():
    good = webp.encode_grey(np.arange(192, dtype=np.uint8), 192)
    for bad in (b"", b"RIFF", good[:40], good[:20] + b"\0" + good[21:]):
        with pytest.raises(ValueError):
            webp.decode_webp(bad)


def test_media_digest(spark, odd, nothing):
    for r in rows_of(media.media_digest(odd)):
        raw = (ODD[r["doc_id"]] if r["doc_id"] is not None else "no id") or ""
        raw = raw.encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert media.media_digest(nothing).count() == 0
    stored = media.read_media(media.write_media(odd.limit(4))).union(media.read_media(odd.limit(1).withColumn("media", F.lit(b"junk"))).select(*odd.columns, "media", "pixels"))
    assert [r.pixels.error is None for r in stored.collect()] == [True] * 4 + [False]
    long = media.payload_of("ab" * 2_000_000)
    assert media.load(media.store(long))[3] == long


# ---- 3 token files


@pytest.mark.parametrize("names_as_text", [False, True])
def test_token_files(spark, odd, nothing, names_as_text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    t.encode_special_tokens = names_as_text
    got = rows_of(token_files.op3_token_files(spark, odd, WORD_BPE, names_as_text=names_as_text))
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 0, 1, 2, 3, 3, *range(4, len(ODD))]
    start = 0
    for r in got:
        text = "no id" if r["doc_id"] is None else ODD[r["doc_id"]]
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.op3_token_files(spark, nothing, WORD_BPE).count() == 0


def test_token_files_in_several_shards(spark, tmp_path):
    # A third of the rows have one id, some of them one text; some have none.
    rows = [(None if i % 7 == 0 else 5 if i % 3 == 0 else 1000 - i, f"text {i if i % 6 else 0} of many") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    shards = token_files.write_token_files(df, str(tmp_path / "x"), WORD_BPE, 2, 49_408, shard_bytes=1000)
    assert shards.count() > 5 and sum(r.n_docs for r in shards.collect()) == 500
    got = sorted(rows_of(token_files.read_token_files(shards, str(tmp_path / "x"))), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert [(i is not None, i or 0) for i in ids] == sorted((i is not None, i or 0) for i, _ in rows)
    starts = np.cumsum([0] + [r["n_tokens"] for r in got])
    assert [r["start"] for r in got] == starts[:-1].tolist()


def test_token_files_special_names_long_texts_and_least_id(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    texts = ["a <|endoftext|> b", "x<|startoftext|>y", "<|ENDOFTEXT|>", "\u00dcber\u00df, na\u00efve. \u039f\u0394\u039f\u03a3. \u0130x, e\u0301t\u0301e\u0301.", "lorem ipsum, " * 100_000 + "z" * 50_000]
    rows = [(np.iinfo(np.int64).min + k, x) for k, x in enumerate(texts)]
    got = sorted(rows_of(token_files.op3_token_files(spark, spark.createDataFrame(rows, "doc_id long, text string"), WORD_BPE)), key=lambda r: r["start"])
    want = [np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4") for x in texts]
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(i, len(w), zlib.crc32(w.tobytes())) for (i, _), w in zip(rows, want, strict=True)]


# ---- 4 decision list


def plain_stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if twice[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_text_stats(spark, odd):
    for r in decision_list.text_stats(odd).select("text", *decision_list.BASE).collect():
        assert tuple(r)[1:] == plain_stats(r.text)


def test_learned_rules_hold_out():
    rng = random.Random(4)
    rows = []
    for _ in range(3000):
        x = [rng.random() for _ in decision_list.FEATURES]
        rows.append((x[1] > 0.8 or (x[2] > 0.7 and x[3] < 0.2), *x))
    rules = decision_list.learn(rows[:2000])
    names = {n: k + 1 for k, n in enumerate(decision_list.FEATURES)}
    fires = lambda r: any(all((r[names[t.feature]] <= t.bound) == t.below for t in rule) for rule in rules)
    assert sum(fires(r) == r[0] for r in rows[2000:]) > 970
    assert decision_list.learn([]) == [] and decision_list.learn([(False, *x[1:]) for x in rows[:50]]) == []


def test_judge_without_labels(spark, odd, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows_of(decision_list.judge(odd, odd, labels))}
    assert not got[1]["kept"] and got[1]["base_failed"] and decision_list.judge(nothing, odd, labels).count() == 0
    assert all(r["kept"] == (not r["base_failed"]) for r in got.values())


# ---- 5 classifier chain


def test_chain_learns_and_handles_odd_rows(spark, odd, nothing):
    rng = random.Random(6)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        said = rng.choices(words, k=60) + ([rng.choice(["scumbag", "scumlike", "moronic"])] if toxic else [])
        rng.shuffle(said)
        docs.append((i, " ".join(said)))
        if i < 600:
            labels.append((i, i % 2, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    chain = classifier_chain.train(d, spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.toxic for r in classifier_chain.score(d.where("doc_id >= 600"), chain).collect()}
    wrong = [i for i, t in got.items() if t != (i % 3 == 0)]
    assert len(wrong) <= 6
    assert classifier_chain.score(odd, chain).count() == len(ODD) + 2 and classifier_chain.score(nothing, chain).count() == 0
    none = classifier_chain.train(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert not any(r.toxic for r in classifier_chain.score(d.limit(5), none).collect())


def test_chain_verdict_uses_earlier_links():
    # Two features say a category each; the verdict is either of them, and its own features are switched off.
    rng = np.random.default_rng(5)
    x = rng.random((600, 2)) < 0.3
    rows = [set(np.flatnonzero(r)) for r in x]
    y = np.stack([x[:, 0], x[:, 1], x.any(1)], 1).astype(int)
    fold = np.arange(600) % 3
    chain = classifier_chain.fit_chain({"a": 0, "b": 1}, rows, y, fold, np.ones((4, 2), bool), ("insult", "threat", "toxic"))
    assert ((chain.probabilities(rows)[:, -1] >= chain.threshold) == x.any(1)).all()
    blind = classifier_chain.Chain(chain.names, chain.known, [w.copy() for w in chain.weights], chain.threshold)
    blind.weights[-1][:2] = 0
    p = blind.probabilities(rows)[:, -1]
    assert p[x.any(1)].min() > p[~x.any(1)].max()


def test_chain_takes_any_categories_and_clashing_columns(spark):
    docs = [(i, ("you scum " if i % 4 == 0 else "i will hurt " if i % 4 == 1 else "a fine day ") + f"w{i}", "x") for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string, judged string")
    labels = spark.createDataFrame([(i, i % 4 == 0, i % 4 == 1) for i in range(300)], "doc_id long, insult boolean, threat boolean")
    chain = classifier_chain.train(d, labels, {"insult": "insult", "threat": "threat", "toxic": "insult OR threat"})
    got = {r.doc_id: r for r in classifier_chain.score(d, chain).collect()}
    assert all(r.toxic == (i % 4 < 2) and (r.p_insult > 0.5) == (i % 4 == 0) and (r.p_threat > 0.5) == (i % 4 == 1) and r.judged == "x" for i, r in got.items())
    long = spark.createDataFrame([(1, "lorem ipsum " * 200_000 + "you scum"), (2, "lorem ipsum " * 200_000 + "a fine day")], "doc_id long, text string")
    assert {r.doc_id: r.toxic for r in classifier_chain.score(long, chain).collect()} == {1: True, 2: False}


# ---- 6 url filter


def test_rules_and_parts(spark):
    urls = ["http://A.Example.com/en/x?q", "https://www.example.com/en/", "http://x.net/fr/1", "http://x.net#f/fr/", "no scheme", None, "a://", "http://notexample.com/en/", "http://com/", "http://example.com", "q://u://v/w"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    host, path = url_filter.host_and_path(F.col("url"))
    got = df.select("page_id", host.alias("h"), path.alias("p")).withColumn("r", url_filter.rule_column(F.col("h"), F.col("p"), url_filter.RULES)).orderBy("page_id").collect()
    assert [(r.h, r.p, r.r) for r in got] == [
        ("a.example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("x.net", "/fr/1", "net/fr/"), ("x.net", "", None), ("", "", None), ("", "", None), ("", "", None),
        ("notexample.com", "/en/", "com/"), ("com", "/", "com/"), ("example.com", "", None), ("u:", "//v/w", None),
    ]


def test_segmenter_matches_brute_force():
    counts = {"free": 50, "bet": 30, "bets": 40, "cheap": 20, "pills": 25, "the": 500, "rapist": 2, "therapist": 9}
    s = url_filter.Segmenter(counts)
    assert s.split("freebets") == ("free", "bets") and s.split("therapist") == ("therapist",) and s.split("") == ()

    def cost(parts):
        return sum(s.cost.get(p, s.unknown + s.letter * len(p)) for p in parts)

    def ways(x):
        return [[]] if not x else [[x[:k], *rest] for k in range(1, len(x) + 1) for rest in ways(x[k:])]

    for name in ("cheappills", "xbetq", "thefreethe", "zzz"):
        assert cost(s.split(name)) == pytest.approx(min(map(cost, ways(name))))


def test_url_model_learns_from_content(spark):
    # Content labels hyphenated hosts; the model carries over to concatenated names and to new hosts.
    pages = [(i, f"http://{'free-bets' if i % 2 else 'good-news'}.org/{'win' if i % 2 else 'read'}/{i}", "<p>free bets win</p>" if i % 2 else "<p>good news read</p>", "clash") for i in range(60)]
    pages += [(96, "http://x.org/" + "\u00e9" * 50_000, "<p>" + "read " * 100_000 + "</p>", "c"), (97, "http://goodnews.org/", "<p>bets</p>", "c"), (98, None, None, None), (99, "http://winfree.org/", None, None), (99, "http://winfree.org/", None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, verdict string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df, *url_filter.train(df), rules=()).collect()}
    assert got[99] == "block" and got[98] == "allow" and got[97] == "allow" and got[1] == "block" and got[2] == "allow" and len(got) == 64
    given = {r.page_id: r.verdict for r in url_filter.filter_urls(df, *url_filter.train(df, F.expr("page_id % 2 = 0")), rules=()).collect()}
    assert given[1] == "allow" and given[2] == "block"
    assert url_filter.filter_urls(df.where("false"), *url_filter.train(df.where("false"))).count() == 0


def test_url_tables_hold_rare_words_and_tokens(spark):
    # 50,100 words and as many tokens that come twice; the seed's page and its word come once.
    name = lambda i: "q" + "".join("bcdfghjklm"[int(c)] for c in f"{i:05d}")
    pages = [(i, f"http://good.org/{name(i // 2)}", f"<p>{name(i // 2)}</p>") for i in range(100_200)]
    pages += [(-1, "http://warez.org/", "<p>warez</p>"), (-2, "http://good.org/zanyduck", "<p>zany duck</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, *url_filter.train(df), rules=()).where("page_id < 0").collect()}
    tokens = [t for _, u, _ in pages for t in ([f"h:{w}" for w in (u.split("/")[2].split("."))] + [f"p:{w}" for w in (("zany", "duck") if u.endswith("zanyduck") else (u.split("/")[3],)) if w])]
    good, bad = collections.Counter(tokens), collections.Counter(["h:warez", "h:org"])
    good.subtract(bad)
    sizes = [sum(c.values()) + len(good) + 1 for c in (good, bad)]
    odds = lambda t: math.log((bad[t] + 1) / sizes[1]) - math.log((good[t] + 1) / sizes[0])
    prior = math.log(2 / len(pages))
    assert got[-1].log_odds == pytest.approx(prior + odds("h:warez") + odds("h:org"), abs=2e-6)
    assert got[-2].log_odds == pytest.approx(prior + odds("h:good") + odds("h:org") + odds("p:zany") + odds("p:duck"), abs=2e-6)


def test_url_runs_and_words_have_any_length(spark):
    # The word lies behind 300 other letters, in the host or in the path; one word has 40 letters.
    long = "abcdefghij" * 4
    urls = [f"http://{'zqx' * 100}warez.org/", f"http://good.org/{'zqx' * 100}poker", f"http://{'zqx' * 100}.org/", f"http://zqx{long}zqx.org/"]
    df = spark.createDataFrame([(i, u, f"<p>zqx zqx zqx {long} {'poker' if i < 2 else ''}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    words, model = url_filter.train(df)
    tokens = {r.host + r.path: r.tokens for r in url_filter.tokens_of(df, words).collect()}
    assert tokens[urls[0][7:]] == ["h:zqx"] * 100 + ["h:warez", "h:org"]
    assert tokens[urls[1][7:]] == ["h:good", "h:org"] + ["p:zqx"] * 100 + ["p:poker"]
    assert tokens[urls[3][7:]] == ["h:zqx", f"h:{long}", "h:zqx", "h:org"]
    assert model.prior == pytest.approx(math.log(3 / 3))
    host_words = {r.page_id: r.host_words.split() for r in url_filter.filter_urls(df, words, model, rules=()).collect()}
    assert host_words[0][-2:] == ["warez", "org"] and len(host_words[0]) == 102


def test_url_look_ups_by_join_and_by_broadcast_agree(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(100)
    got = [sorted(tuple(r) for r in url_filter.filter_urls(df.select("page_id", "url"), *url_filter.train(df, most=most), most=most).collect()) for most in (0, 3, 50_000)]
    assert got[0] == got[1] == got[2]


# ---- 7 word pieces


def greedy(word, first, later):
    n = at = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in (first if at == 0 else later):
                at, n = end, n + 1
                break
        else:
            return -1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(c % 3 for c in b)), max_size=12), st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(c % 3 for c in b)), max_size=12), st.binary(min_size=1, max_size=14).map(lambda b: bytes(c % 3 for c in b)))
def test_automaton_is_greedy(first, later, word):
    assert wordpiece.Automaton(first, later).count(word) == greedy(word, first, later)


def test_token_counts(spark, odd, nothing):
    first, later = wordpiece.word_vocabulary(byte_bpe.read_ranks(RANKS))
    for r in rows_of(wordpiece.count_tokens(odd, RANKS)):
        text = "no id" if r["doc_id"] is None else ODD[r["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(greedy(w.encode(), first, later) for w in words))
    assert wordpiece.count_tokens(nothing, RANKS).count() == 0


# ---- 8 byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=50, deadline=None)
@given(st.binary(min_size=1, max_size=300))
def test_heap_merge_matches(tiktoken_encoding, piece):
    assert byte_bpe.merge(piece, tiktoken_encoding._mergeable_ranks) == tiktoken_encoding._core_bpe.encode_single_piece(piece)


def test_byte_bpe(spark, odd, nothing, tiktoken_encoding):
    for form in (byte_bpe.encode, byte_bpe.encode_by_columns):
        for r in rows_of(byte_bpe.digest(form(odd, RANKS, public_tokenizers.PATTERN))):
            text = "no id" if r["doc_id"] is None else ODD[r["doc_id"]] or ""
            ids = tiktoken_encoding.encode_ordinary(text)
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), text[:40]
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_long_texts_and_full_memory(tiktoken_encoding):
    rng = random.Random(8)
    text = "z" * 200_000 + " " + "".join(rng.choices("abcdefgh .,\n\u00e9", k=300_000)) + " " * 5000 + "end"
    coder = byte_bpe.PieceCoder(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN, 64)
    ids = np.array(tiktoken_encoding.encode_ordinary(text), "<u4").tobytes()
    assert coder.encode(text) == ids and coder.decode(ids) == text.encode()
    short = text.replace("  ", " ").replace("\n", "")
    assert np.frombuffer(coder.encode(short), "<u4").tolist() == tiktoken_encoding.encode_ordinary(short) and len(coder.chunks) <= 65


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1,'s \n\t\r\u00a0\u2003\u00e9\x85\x1c", max_size=25))
def test_chunks_have_their_own_matches(coder, tiktoken_encoding, text):
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == tiktoken_encoding.encode_ordinary(text)


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.PieceCoder(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


def test_pattern_classes_agree_on_all_code_points(tiktoken_encoding):
    coder = byte_bpe.PieceCoder(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    for at in range(0, 0x110000, 4096):
        text = "".join(f"a{c}1{c} {c}a" for c in map(chr, range(at, at + 4096)) if not 0xD800 <= ord(c) < 0xE000)
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == tiktoken_encoding.encode_ordinary(text)


# ---- 9 n-gram Jaccard join


def brute_links(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_jaccard_components(spark, odd, nothing):
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        base = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.choice([8, 30, 60]))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(["Zed", "zed", "q1"])
            texts.append((len(texts) * 3, " ".join(copy[: rng.choice([len(copy), len(copy) - 2])])))
    texts += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "a b c")]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, n string").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(df).collect()} == brute_links(texts)
    got = rows_of(jaccard_join.link(odd))
    assert len(got) == len(ODD) + 2 and [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert jaccard_join.link(nothing).count() == 0
    kept = {r.doc_id for r in jaccard_join.keep_one(df).collect()}
    assert kept == {i for i, (_, c) in brute_links(texts).items() if i == c}


# ---- 10 packing


def plain_best_fit(lengths, costs):
    """Piece by piece: the fullest bin that has room, or a new one of the least cost per usable token."""
    rooms, sizes, fills, left = [], [], [], sum(lengths)
    for need in sorted(lengths, reverse=True):
        fits = [b for b, room in enumerate(rooms) if room >= need]
        if fits:
            b = min(fits, key=lambda b: (rooms[b], sizes[b]))
        else:
            b = len(rooms)
            rooms.append(min((c for c in costs if c >= need), key=lambda c: (costs[c] / min(c, left), c)))
            sizes.append(rooms[b])
            fills.append([])
        rooms[b] -= need
        fills[b].append(need)
        left -= need
    return sorted(min(c for c in costs if c >= sum(f)) for f in fills), sorted(map(sum, fills))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.sampled_from([{10: 10.0, 20: 25.0, 40: 60.0}, {40: 1.0, 20: 1.0}, {7: 9.0, 40: 40.0}]))
def test_classes_are_best_fit(lengths, costs):
    bins = packing.pack_lengths(collections.Counter(lengths), costs)
    got = collections.Counter(n for b in bins for n, k in b.content for _ in range(k * b.times))
    assert got == collections.Counter(lengths)
    fills = sorted(sum(n * k for n, k in b.content) for b in bins for _ in range(b.times))
    assert (sorted(b.capacity for b in bins for _ in range(b.times)), fills) == plain_best_fit(lengths, costs)


def check_bins(got):
    by_bin = collections.defaultdict(list)
    for r in got:
        by_bin[r["bin_id"]].append(r)
    for rows in by_bin.values():
        rows.sort(key=lambda r: r["bin_pos"])
        at = 0
        for k, r in enumerate(rows):
            assert (r["bin_pos"], r["bin_offset"]) == (k, at)
            at += r["piece_tokens"]
        assert at == rows[0]["bin_tokens"] <= rows[0]["bin_capacity"]
    return sorted(rows[0]["bin_capacity"] for rows in by_bin.values()), sorted(rows[0]["bin_tokens"] for rows in by_bin.values())


def test_packing_rows(spark, odd, nothing):
    long = spark.createDataFrame([(1, None, "x"), (2, 10_000, "x"), (3, -4, "x"), (3, -4, "x"), (None, 7, "x")], "doc_id long, n long, bin_id string")
    pieces = rows_of(packing.best_fit_pack(long, F.col("n")))
    assert sorted(r["piece_tokens"] for r in pieces if r["doc_id"] == 2) == [1808, 4096, 4096] and len(pieces) == 7
    assert check_bins(pieces) == plain_best_fit([1, 4096, 4096, 1808, 1, 1, 7], packing.LENGTHS)
    assert packing.best_fit_pack(nothing, F.lit(1)).count() == 0


def test_packing_does_not_depend_on_files(spark):
    rng = random.Random(10)
    rows = [(i if i % 5 else None, rng.choice([1, 3, 300, 511, 512, 513, 4000, 5000, rng.randrange(1, 9000)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, n long")
    got = [rows_of(packing.best_fit_pack(d, F.col("n"))) for d in (df.repartition(7), df.coalesce(1))]
    key = lambda rows: sorted((str(r["doc_id"]), *list(r.values())[1:]) for r in rows)
    assert key(got[0]) == key(got[1])
    lengths = [min(4096, n - k) for _, n in rows for k in range(0, n, 4096)]
    assert check_bins(got[0]) == plain_best_fit(lengths, packing.LENGTHS)


def test_sequences_hold_all_tokens(spark, odd, tiktoken_encoding):
    coded = byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    want = collections.Counter()
    for r in odd.collect():
        want[(r.doc_id, tuple(tiktoken_encoding.encode_ordinary(r.text or "")) + (50256,))] += 1
    pieces = collections.defaultdict(list)
    for r in rows_of(packing.sequences(coded, 50256, {64: 64.0, 256: 300.0})):
        ids = np.frombuffer(r["tokens"], "<u4").tolist()
        assert len(ids) <= r["capacity"] and [p["offset"] for p in r["pieces"]][0] == 0
        cuts = [p["offset"] for p in r["pieces"]] + [len(ids)]
        for p, a, b in zip(r["pieces"], cuts, cuts[1:]):
            pieces[p["doc_id"], p["piece"]].append(tuple(ids[a:b]))
    got = collections.Counter()
    for doc_id in {d for d, _ in pieces}:
        parts = [pieces[doc_id, k] for k in range(max(k for d, k in pieces if d == doc_id) + 1)]
        for whole in zip(*parts) if doc_id != 3 else [tuple(p[:1][0] for p in parts)] * 2:
            got[(doc_id, sum(whole, ()))] += 1
    assert got == want


def test_jaccard_rows_of_one_id_are_one_document(spark):
    a, b, c, d = ("red fox runs far off", "blue owl sits still here now", "one two three four five six", "other words in this last text")
    rows = [(3, a), (7, a), (7, b), (9, b), (7, None), (20, c), (12, c), (12, d), (11, d), (30, a + " x"), (30, "lone"), (40, ""), (50, "alone here"), (50, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.defaultdict(list)
    for r in jaccard_join.link(df).collect():
        got[r.doc_id].append(r.component_id)
    assert got == {3: [3], 7: [3] * 3, 9: [3], 20: [11], 12: [11] * 2, 11: [11], 30: [30] * 2, 40: [40], 50: [50] * 2}
    assert {r.doc_id for r in jaccard_join.keep_one(df).collect()} == {3, 11, 30, 40, 50}
