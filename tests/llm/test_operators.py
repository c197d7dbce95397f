"""Operators against brute force, round trips and planted cases on small frames."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import Row
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pagemill.llm import chat, decontam, eliasfano, linededup, mixing, ngramlm, quality, queries, records, simhash, trietokens, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def _docs(spark, *texts, source="s", lang="en"):
    return spark.createDataFrame([(k, t, lang, source, len(t or "")) for k, t in enumerate(texts)], DOCS)


# Records


def test_records_equal_the_whole_encoding_and_round_trip(spark, documents):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.VOCABULARY)
    whole = Tokenizer.from_file(path)
    before = 0
    ours = {r["id"]: r for r in records.round_trip(documents, path).collect()}
    for row in documents.orderBy("doc_id").collect():
        ids = whole.encode(row["text"] or "", add_special_tokens=False).ids + [0]
        got = ours[row["doc_id"]]
        assert (got["start"], got["n_tokens"]) == (before, len(ids))
        assert got["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        before += len(ids)


@pytest.mark.parametrize(
    "text", ["", " ", "a  b", "a\n\nb", " lead", "trail ", "tab\tand\u00a0nbsp", "x<|endoftext|> y", "it's we'll 12ab é\u2028z", "a\r\nb", "日本語 text\x1cq", "\n", "😀 ok\x85"]
)
def test_encoder_splits_only_where_the_pattern_allows(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.VOCABULARY)
    expect = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(records.encoder(path)(text), "<u4").tolist() == expect


def test_encoder_equals_the_library_on_random_white_space():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.VOCABULARY)
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    draw = np.random.default_rng(17)
    letters = np.array([*"aBz1_'.,é×ñ日😀", " ", " ", "\n", "\n", *spaces])
    texts = ["".join(draw.choice(letters, draw.integers(0, 16))) for _ in range(30_000)]
    texts += ["Hello\n\u00a0 World", "don't we'll 'twas I'm12'd", "a\x1cb\x1f c", "x" * 500 + " y" * 500]
    encode = records.encoder(path)
    for text, made in zip(texts, Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encode(text), "<u4").tolist() == made.ids, repr(text)


def test_a_text_of_known_letters_is_cut_into_parts_at_once():
    encode = records.Encoder(public_tokenizers.path(queries.VOCABULARY))
    for text in ("one, two. two, one! don't\nÜber 12a\t(two)\n", " two one", "two\n"):
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.whole.encode(text, add_special_tokens=False).ids
    assert not encode.units.young and {" two", ","} < set(encode.words.young)


def test_memo_is_bounded_by_bytes():
    memo = records.Memo(10_000)
    for k in range(1000):
        memo.put(f"key{k}", b"12345678")
    assert len(memo.young) + len(memo.old) < 2 * 10_000 // records.ENTRY
    memo.put("x" * 1000, b"1")
    assert "x" * 1000 not in memo.young


def test_broken_records_are_refused():
    good = records.frame(b"\x02ab")
    assert records.unframe(good) == b"\x02ab"
    for at in range(len(good)):
        with pytest.raises(ValueError):
            records.unframe(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])


# Mixing


def test_mix_comes_near_its_targets(spark, documents):
    rows = mixing.mix(documents).select("row.source", "size", "source_size", "target", "times").collect()
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in rows}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total)
    for source, (target, size) in targets.items():
        own = [r for r in rows if r["source"] == source]
        assert target <= 2 * size + 1e-6
        assert abs(sum(r["times"] * r["size"] for r in own) - target) <= max(r["size"] for r in own) / 2 + 1
        assert all(0 <= r["times"] <= 2 for r in own)


def test_water_level_is_the_repeated_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 300, "d": 5, "e": 2000}
    thin = spark.createDataFrame([(False, s, k, n, 0.0) for k, (s, n) in enumerate(sizes.items())], "none boolean, source string, id long, size long, key double")
    got = {r["source"]: r["target"] for r in mixing.targets(thin).collect()}
    weight = dict(zip(sorted(sizes), itertools.cycle((5, 2, 1)), strict=False))
    whole, done = 1.5 * sum(sizes.values()), {}
    while True:
        rest, w = whole - sum(done.values()), sum(weight[s] for s in sizes if s not in done)
        above = {s for s in sizes if s not in done and weight[s] / w * rest > 2 * sizes[s]}
        if not above:
            break
        done |= {s: 2.0 * sizes[s] for s in above}
    expect = done | {s: weight[s] / w * rest for s in sizes if s not in done}
    assert got == pytest.approx(expect)


# LM scoring


def test_elias_fano_finds_what_it_holds():
    rng = np.random.default_rng(3)
    for n, top in ((1, 4), (50, 60), (1000, 10**5), (3000, 2**60)):
        keys = np.unique(rng.integers(0, top, n))
        sequence = eliasfano.Sequence(eliasfano.encode(keys, "k"), "k")
        assert (sequence.access(np.arange(len(keys))) == keys.astype(np.uint64)).all()
        probe = np.concatenate([keys, rng.integers(0, top, 300)])
        assert (sequence.successor(probe) == np.searchsorted(keys, probe)).all()


def _brute_model(train):
    """The same smoothing over plain dictionaries."""
    single, double, triple = Counter(), Counter(), Counter()
    for run in train:
        single.update(run)
        whole = ["\n", *run]
        double.update(zip(whole, whole[1:], strict=False))
    double = {k: n for k, n in double.items() if n >= 2}
    for run in train:
        whole = ["\n", *run]
        triple.update(t for t in zip(whole, whole[1:], whole[2:], strict=False) if t[:2] in double and t[1:] in double)
    triple = {k: n for k, n in triple.items() if n >= 2}
    discount, taken3, taken1 = ngramlm.DISCOUNT, Counter(), Counter()
    for (_, b, c), n in triple.items():
        taken3[b, c] += n - discount
    gain3 = {k: (n - discount) / double[k[:2]] for k, n in triple.items()}
    context = Counter()
    for (a, _), n in taken3.items():
        context[a] += n
    gain2 = {}
    for (a, b), n in double.items():
        rest = max(n - taken3[a, b] - discount, 0)
        gain2[a, b] = rest / max(single[a] - context[a], 1e-12)
        taken1[b] += taken3[a, b] + rest
    total = sum(single.values()) - sum(taken1.values()) + len(single) + 1
    left2, left3 = Counter(), Counter()
    for (a, _), g in gain2.items():
        left2[a] += g
    for (a, b, _), g in gain3.items():
        left3[a, b] += g

    def log(run):
        out, whole = 0.0, ["\n", *run]
        for k in range(1, len(whole)):
            c, b = whole[k], whole[k - 1]
            p = (single[c] - taken1[c] + 1) / total if c in single else 1 / total
            p = gain2.get((b, c), 0) + (1 - left2[b]) * p
            if k > 1:
                p = gain3.get((whole[k - 2], b, c), 0) + (1 - left3[whole[k - 2], b]) * p
            out += math.log10(p)
        return out

    return log, single


def test_scores_equal_a_plain_model(spark, documents):
    rows = {r["id"]: r for r in ngramlm.score(documents).collect()}
    runs = {r["doc_id"]: [w.decode() for w in r["text"].encode().lower().split()] + ["\n"] for r in documents.collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in runs}
    log, single = _brute_model([r for k, r in runs.items() if not held[k]])
    n, v = sum(single.values()), len(single)
    ours = theirs = base = 0.0
    for k, run in runs.items():
        row = rows[k]
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (held[k], len(run), n)
        assert row["n_known"] == sum(w in single for w in run)
        assert row["base_score"] == pytest.approx(sum(math.log10((single[w] + 1) / (n + v + 1)) for w in run))
        assert row["score"] == pytest.approx(log(run), rel=0.02, abs=1.0)
        if held[k]:
            ours, theirs, base = ours + row["score"], theirs + log(run), base + row["base_score"]
    assert ours == pytest.approx(theirs, rel=0.01)
    assert ours > base


# Lines


def test_lines_in_many_documents_leave_all(spark):
    texts = [f" Footer \nown {k}\nfooter\n\nx" for k in range(10)] + ["nothing", "", None, "FOOTER"]
    rows = {r["doc_id"]: r for r in linededup.drop_lines(_docs(spark, *texts)).select("row.doc_id", "kept_text", "n_lines", "n_dropped").collect()}
    assert rows[3]["kept_text"] == "own 3\n" and rows[3]["n_dropped"] == 3
    assert (rows[11]["kept_text"], rows[11]["n_lines"], rows[12]["n_lines"]) == ("", 1, 1)
    assert rows[13]["n_dropped"] == 1


# Decontamination


def test_leaks_are_those_of_a_brute_search(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r["item_id"]: decontam.terms_of(r["text"].encode()) for r in benchmark.collect()}
    expect = set()
    for row in docs.collect():
        words = decontam.terms_of(row["text"].encode())
        joined = b" ".join([b"", *words, b""])
        expect |= {(row["doc_id"], k) for k, run in items.items() if b" ".join([b"", *run, b""]) in joined}
    rows = decontam.find_leaks(docs, benchmark).collect()
    found = {(r["id"], r["item_id"]): r["share"] for r in rows}
    assert expect and len(expect & {*found}) >= 0.9 * len(expect)
    # What is no whole copy holds most of the item in order.
    assert all(share >= decontam.LIKELY_SHARE for share in found.values())


def test_paraphrases_leak_with_their_answer_only(spark):
    filler = " ".join(f"filler{k} word{k % 7} other{k % 11}" for k in range(60))
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike. The answer is november oscar papa"
    near = "alpha bravo changed delta echo replaced golf hotel different juliett kilo new mike. The answer is november oscar papa"
    half = "alpha bravo changed delta echo replaced golf hotel different juliett kilo new mike. The reply was quite other here"
    docs = _docs(spark, *(f"{filler} {t} {filler}" for t in (item, near, half, filler)), None, "")
    benchmark = spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")
    assert {(r["id"], r["item_id"]) for r in decontam.find_leaks(docs, benchmark).collect()} == {(0, 7), (1, 7)}


def test_lcs_equals_dynamic_programming():
    rng = np.random.default_rng(5)
    for _ in range(30):
        a, b = rng.integers(0, 5, 12).tolist(), rng.integers(0, 5, 20).tolist()
        table = np.zeros((13, 21), int)
        for i, j in itertools.product(range(12), range(20)):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontam.lcs(decontam.Index._bits(a), 12, b) == table[-1, -1]


# Token counts


def test_token_counts_equal_plain_segmentation(spark, documents):
    scores, longest = trietokens.pieces(public_tokenizers.path(queries.PIECES))
    worst = min(scores.values()) - trietokens.BYTE_PENALTY

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            found = [(best[s][0] + scores[word[s:end]], best[s][1] + 1) for s in range(max(0, end - longest), end) if word[s:end] in scores]
            size = len(word[end - 1].encode())
            best.append(max(found, key=lambda x: x[0]) if found else (best[-1][0] + worst * size, best[-1][1] + size))
        return best[-1][1]

    extra = _docs(spark, None, "", "\U0001f600 \ufffd zz", "a" * 3000)
    rows = {r["id"]: r for r in trietokens.token_counts(documents.limit(40).select(*extra.columns).union(extra.withColumn("doc_id", extra.doc_id - 10)), public_tokenizers.path(queries.PIECES)).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in documents.limit(40).collect()} | {-10: "", -9: "", -8: "\U0001f600 \ufffd zz", -7: "a" * 3000}
    for k, text in texts.items():
        words = [w.decode() for w in text.encode().split()]
        assert (rows[k]["n_words"], rows[k]["n_tokens"]) == (len(words), sum(plain("▁" + w) for w in words))


# URLs


def test_urls_follow_rules_then_the_model(spark, sf):
    model = urlfilter.train(urlfilter.labelled(spark))
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame(
        [(-1, None), (-2, "no scheme"), (-3, "http://EXAMPLE.com/en/x"), (-4, "http://www.example.com/en/?q"), (-5, "ftp://a.net/es/1#f"), (-6, "http://notcom/"), (-7, "x://com"), (-8, "http://m.spam-farm.example.org/en/1")], "page_id long, url string"
    )
    rows = {r["page_id"]: r for r in urlfilter.judge(pages.union(odd), model).select("row.*", "host", "path", "rule", "verdict").collect()}
    weights, intercept = model

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = regex.match(r"[^/?#]*", rest)[0]
        path = regex.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in urlfilter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        if fits:
            best = max(fits, key=lambda r: len(r[0] + r[1]))
            return host, path, best[0] + best[1], best[2]
        grams = set()
        for mark, part in (("h", host), ("p", path)):
            text = f"^{part}$"
            for n in urlfilter.SIZES:
                for i in range(max(len(text) - n + 1, 1)):
                    code = xxh64_intdigest(text[i : i + n], xxh64_intdigest(mark, 42))
                    grams.add((code - (1 << 64) * (code >> 63)) % urlfilter.SLOTS)
        return host, path, None, "block" if intercept + sum(weights[g] for g in grams) > 0 else "allow"

    for row in rows.values():
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == brute(row["url"]), row["url"]
    assert rows[-8]["verdict"] == "block"


def test_url_model_holds_out(spark):
    table = urlfilter.labelled(spark).collect()
    train = spark.createDataFrame([r for k, r in enumerate(table) if k % 4], "family string, label double, url string")
    test = spark.createDataFrame([r for k, r in enumerate(table) if not k % 4], "family string, label double, url string")
    rows = urlfilter.judge(test, urlfilter.train(train)).select("row.label", "logit").collect()
    assert sum((r["logit"] > 0) == (r["label"] > 0) for r in rows) >= 0.85 * len(rows)


def test_urls_of_hosts_outside_the_table_are_told_apart(spark):
    """Undecided pages of sf0.1: none of their unwanted host names stands in the labelled table."""
    unwanted = "casino-win|ads-track|free-bets|spam-farm|cheap-pills|adult-x"
    table = urlfilter.labelled(spark)
    assert table.filter(F.col("url").rlike(unwanted)).count() == 0
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    rows = urlfilter.judge(pages, urlfilter.train(table)).filter("rule is null").select("host", "verdict").collect()
    bad = [r["verdict"] == "block" for r in rows if any(u in r["host"] for u in unwanted.split("|"))]
    good = [r["verdict"] == "block" for r in rows if not any(u in r["host"] for u in unwanted.split("|"))]
    assert sum(bad) >= 0.9 * len(bad) and len(bad) >= 10
    assert sum(good) <= 0.005 * len(good) and len(good) > 1000


def test_whole_families_of_hosts_can_be_held_out(spark):
    """A kind of site that training never saw lies between plain sites and the kinds it saw."""
    table = urlfilter.labelled(spark).cache()
    model = urlfilter.train(table.filter("family <> 'fraud'"))
    logits = urlfilter.judge(table, model).select("row.family", "logit").groupBy("family").agg(F.avg("logit").alias("mean")).collect()
    mean = {r["family"]: r["mean"] for r in logits}
    assert mean["plain"] < mean["fraud"] < min(v for k, v in mean.items() if k not in ("plain", "fraud"))



# SimHash


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.masks()
    for pair in itertools.combinations(range(simhash.BITS), 2):
        flip = (1 << pair[0]) | (1 << pair[1])
        assert any(not flip & m for m in masks)


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(12):
        base = list(rng.choice(words, 200))
        texts.append(" ".join(base))
        for _ in range(14 if k < 3 else 3):
            copy = list(base)
            for at in rng.integers(0, 200, rng.integers(0, 3)):
                copy[at] = str(rng.choice(words))
            texts.append(" ".join(copy))
    texts += ["", None, "one two", "ONE two", " "]
    rows = {r["id"]: r for r in simhash.classes(_docs(spark, *texts)).collect()}
    codes = [simhash.fingerprint((t or "").encode()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if (codes[a] ^ codes[b]).bit_count() <= simhash.RADIUS:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    assert [rows[k]["fp"] % (1 << 64) for k in rows] == [codes[k] for k in rows]
    assert {k: rows[k]["component_id"] for k in rows} == {k: find(k) for k in rows}
    stay = sorted(r["doc_id"] for r in simhash.one_of_each(_docs(spark, *texts)).collect())
    assert stay == sorted({find(k) for k in range(len(texts))})


def test_fingerprint_follows_its_definition():
    text = "The cat SAT\ton the mat É"
    words = ["the", "cat", "sat", "on", "the", "mat", "É"]
    hashes = [xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(5)]
    assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 5)


def test_long_chains_of_links_become_one_class(spark):
    from pagemill.llm.store import work_folder

    edges = spark.createDataFrame([(k * 7919 % 1009, (k + 1) * 7919 % 1009) for k in range(500)], "src long, dst long")
    rows = simhash.components(edges, work_folder(spark)).collect()
    assert len({r["root"] for r in rows}) == 1 and rows[0]["root"] == min(k * 7919 % 1009 for k in range(501))


# Chats


def test_prefixes_and_equals_collapse(spark):
    rows = []
    for conv, n in ((1, 2), (2, 4), (3, 4), (5, 600)):
        rows += [Row(conv_id=conv, turn=t, role="user" if t % 2 == 0 else "assistant", text=f"{'long' if conv == 5 else 'turn'} {t}") for t in range(n)]
    rows += [Row(conv_id=4, turn=0, role="user", text="turn 0"), Row(conv_id=4, turn=1, role="assistant", text="else"), Row(conv_id=2, turn=0, role="user", text="turn 0"), Row(conv_id=6, turn=0, role=None, text=None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.render(frame).collect()
    parts = {(r["conv_id"], r["part"]): (r["n_turns"], r["n_logged"]) for r in got}
    assert parts == {(2, 0): (4, 2), (4, 0): (2, 1), (5, 0): (256, 1), (5, 1): (256, 1), (5, 2): (88, 1), (6, 0): (1, 1)}
    shown = next(r["chat"] for r in got if r["conv_id"] == 4)
    assert shown == "<|user|>\nturn 0<|end|>\n<|assistant|>\nelse<|end|>\n"
    assert chat.render(frame.limit(0)).count() == 0


# Quality


def test_junk_fails_and_prose_stays(spark, documents):
    base = documents.select("doc_id", "text", "lang", "source", "n_chars")
    junk = _docs(spark, "again " * 100, " ".join(f"zq{k}x###" for k in range(300)), "", None, "few words")
    rows = quality.assess(base.union(junk.withColumn("doc_id", junk.doc_id - 10))).select("row.doc_id", "base_failed", "kept").collect()
    said = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in rows}
    assert said[-10] == (True, False) and said[-9] == (False, False)
    assert said[-8] == said[-7] == said[-6] == (True, False)
    assert sum(r["kept"] for r in rows) > 100


def test_distance_is_that_of_the_definition(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        quality.distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("far"),
        quality.distance(F.array(F.lit(0.3), F.lit(0.7)), F.array(F.lit(0.3), F.lit(0.7))).alias("same"),
    ).first()
    assert (row["far"], row["same"]) == (pytest.approx(1.0), 0.0)
