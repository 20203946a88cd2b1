"""Operators on documents, against brute force on small fixtures."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_support import ODD, passage
from pyspark.sql import functions as F

from sextant.llm import common, golay, language_id, line_dedup, media, mixing, packing, quality_classifier, quality_rules, simhash_dedup, tokens
from sextant.llm.components import components

WS = " \t\n\x0b\x0c\r"


def split(text):
    return [w for w in "".join(" " if c in WS else c for c in text or "").split(" ") if w]


# --- quality rules ------------------------------------------------------------------------------------------------


def base_of(text):
    w = split(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + o for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_ledger_measures_like_brute_force(odd):
    led = quality_rules.ledger(odd.select("doc_id", "text", "size", "_m"))
    m = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = led.select("text", *[F.col(f"_m.{x}").alias(x) for x in m], "_bits").collect()
    assert len(got) == len(ODD)
    for r in got:
        assert tuple(r[x] for x in m) == base_of(r["text"])
        assert bool(r["_bits"] & 1) == (r["n_words"] < 50)


def test_policies_and_ablations_agree(make):
    docs = make([(1, passage(1, 60)), (2, "short"), (3, "a b c " * 40), (4, " | ".join(passage(2, 60).split())), (5, passage(3, 80).upper())])
    led = quality_rules.apply_policy(quality_rules.ledger(docs.drop("kept"))).select("doc_id", "_bits", "kept").collect()
    assert {r["doc_id"] for r in led if r["kept"]} == {1}
    rows = {r["rule"]: r for r in quality_rules.ablations(quality_rules.ledger(docs)).collect()}
    alone = Counter(quality_rules.NAMES[r["_bits"].bit_length() - 1] for r in led if bin(r["_bits"]).count("1") == 1)
    assert {k: r["n_failed_alone"] for k, r in rows.items() if r["n_failed_alone"]} == dict(alone)
    assert [r["doc_id"] for r in quality_rules.filter_documents(docs).collect()] == [1]
    assert [tuple(r) for r in quality_rules.filter_documents(docs).collect()] == [tuple(r) for r in docs.filter("doc_id = 1").collect()]


def test_ledger_of_nothing(empty):
    assert quality_rules.ledger(empty.drop("_m")).count() == 0
    assert quality_rules.filter_documents(empty).count() == 0


# --- line dedup ----------------------------------------------------------------------------------------------------


def dedup_brute(rows, least):
    """rows: (key, text) in order. Marks every line in a run of ``least`` words or more that occurs before."""
    seqs = []
    for text in rows:
        lines = [(i, " ".join(split(x))) for i, x in enumerate((text or "").split("\n")) if split(x)]
        seqs.append(lines)
    first, gone = {}, [set() for _ in rows]
    for d, lines in enumerate(seqs):
        for i in range(len(lines)):
            words = 0
            for j in range(i, len(lines)):
                words += len(lines[j][1].split())
                if words >= least:
                    key = tuple(x for _, x in lines[i : j + 1])
                    if first.setdefault(key, (d, i)) != (d, i):
                        gone[d] |= {x for x, _ in lines[i : j + 1]}
    return ["\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in g) if g else t for t, g in zip(rows, gone)], [len(g) for g in gone]


@pytest.mark.parametrize("seed", range(4))
def test_line_runs_like_brute_force(make, seed):
    rng = random.Random(seed)
    pool = [passage(i, rng.randint(1, 14)) for i in range(25)]
    texts = ["\n".join(rng.choice(["", "  "]) if rng.random() < 0.1 else rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(30)]
    for _ in range(6):  # shared runs
        a, b = rng.randrange(30), rng.randrange(30)
        texts[b] += "\n" + "\n".join(texts[a].split("\n")[: rng.randint(1, 9)])
    want, n = dedup_brute(texts, 20)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(make(list(enumerate(texts))), 20).collect()}
    assert sum(n) > 0
    assert [got[i]["n_removed"] for i in range(30)] == n
    assert [got[i]["text"] for i in range(30)] == want


def test_line_dedup_of_odd_rows(odd, empty):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"]
    got = out.collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["text"] is None and by[3]["text"] == " \t\n " and by[3]["n_lines"] == 0
    assert by[8]["n_lines"] == 3 and by[8]["n_removed"] == 2
    assert by[7]["n_removed"] == 1 and by[7]["text"] == ""  # a later copy of 4
    assert by[9]["n_removed"] == 0 and by[11]["n_removed"] == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_does_not_depend_on_the_order_of_rows(make):
    p = [passage(i, 60) for i in range(3)]
    rows = [(1, p[0] + "\na"), (1, p[0] + "\nb"), (1, p[1]), (None, p[1] + "\nc"), (None, p[2]), (2, p[2] + "\n" + p[0])]
    results = {tuple(sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.dedup_lines(make(rows[i:] + rows[:i])).collect())) for i in (0, 2, 5)}
    assert len(results) == 1


def test_white_space_does_not_tell_lines_apart(make):
    p = passage(1, 55)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(make([(1, p + "\nend"), (2, "start\n\t " + p.replace(" ", " \t") + "\r\nx")])).collect()}
    assert got == {1: p + "\nend", 2: "start\nx"}


# --- SimHash -------------------------------------------------------------------------------------------------------


def test_golay_is_perfect_and_shares_an_index_within_two_flips():
    assert len(np.unique(golay.leaders())) == 2048
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    keys = golay.nearby(words)
    assert set((keys >= 0).sum(axis=1)) == {1, 6}
    for flips in (1, 2):
        other = words.copy()
        for _ in range(flips):
            other ^= 1 << rng.integers(0, 23, len(words))
        theirs = golay.nearby(other)
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(keys, theirs))


def partition(fps, ids, distance=2):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)].append(ids[i])
    return [min(least[find(i)], default=None) for i in range(len(fps))]


@pytest.mark.parametrize("bucket", [48, 3])
def test_classes_like_all_pairs(spark, bucket):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1, 1 << 63]
    for i in range(300):  # chains and balls of near fingerprints
        x = rng.choice(fps[:60] if i % 2 else fps)
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    ids = list(range(100, 100 + len(fps)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = dict(spark.createDataFrame(list(zip(ids, signed)), "_id long, _fp long").transform(lambda d: d.join(simhash_dedup.classes(d, bucket), "_fp")).select("_id", "component_id").collect())
    assert [got[i] for i in ids] == partition(fps, ids)


def test_fingerprint_bit_by_bit():
    import xxhash

    for text in ["", "a", "A b", "one two three four", passage(3, 200), "x y z " * 50, "Ä B c d"]:
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in split(text)]
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        hs = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert simhash_dedup.fingerprint(text) == want


def test_near_duplicates_of_odd_rows(odd, empty, spark):
    got = simhash_dedup.near_duplicates(odd).collect()
    fps = [simhash_dedup.fingerprint(r[1]) for r in ODD]
    want = Counter((r[0], f"{f:016x}", c) for r, f, c in zip(ODD, fps, partition(fps, [r[0] for r in ODD])))
    assert Counter(tuple(r) for r in got) == want
    assert simhash_dedup.near_duplicates(empty).count() == 0
    assert (spark.sql("SELECT xxhash64('a b c') x").first()[0] & (1 << 64) - 1) == simhash_dedup.fingerprint("A b\tC")  # one shingle is its own majority


def test_one_row_of_each_group_stays(odd, empty, make):
    out = simhash_dedup.keep_one(odd)
    assert out.columns == odd.columns and out.exceptAll(odd).count() == 0
    fps = [simhash_dedup.fingerprint(r[1]) for r in ODD]
    assert out.count() == len(set(partition(fps, list(range(len(fps))))))
    assert simhash_dedup.keep_one(empty).count() == 0
    assert [r["doc_id"] for r in simhash_dedup.keep_one(make([(3, "x y z"), (2, "x y z"), (2, "x y z")])).collect()] == [2]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = dict(components(edges).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# --- mixing --------------------------------------------------------------------------------------------------------


def test_recipe_fills_up_to_the_caps():
    shares = mixing.recipe({"b": 100, "a": 10, None: 1000}, [5, 2, 1], 900.0)
    assert [(s.source, s.target) for s in shares] == [("a", 20.0), ("b", 200.0), (None, 680.0)]
    assert mixing.recipe({}, [1], 0.0) == []


def test_mix_serves_targets(make):
    rng = random.Random(2)
    rows = [(i, passage(i, rng.randint(1, 40)), "s%d" % (0 if rng.random() < 0.4 else rng.randrange(1, 8))) for i in range(600)]
    docs = make(rows)
    out = mixing.mix(docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), mixing.word_count(F.col("text")).alias("_size")), [5.0, 2.0, 1.0], 1.5)
    got = out.collect()
    total = sum(r["_size"] for r in got)
    taken = sum(r["_size"] * r["_copies"] for r in got)
    assert 1.5 * total - 40 <= taken <= 1.5 * total
    by, target = Counter(), {}
    for r in got:
        by[r["_source"]] += r["_size"] * r["_copies"]
        target[r["_source"]] = r["_target"]
        assert 0 <= r["_copies"] <= 2
    assert all(abs(by[s] - target[s]) <= 45 for s in target)
    again = {r["_id"]: r["_copies"] for r in mixing.mix(docs.repartition(7).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), mixing.word_count(F.col("text")).alias("_size")), [5.0, 2.0, 1.0], 1.5).collect()}
    assert again == {r["_id"]: r["_copies"] for r in got}


def test_mix_of_odd_rows(odd, empty):
    assert mixing.mixed_documents(empty).count() == 0
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and out.distinct().exceptAll(odd.distinct()).count() == 0
    sizes = [len(split(r[1])) for r in ODD]
    assert sum(len(split(r["text"])) for r in out.collect()) <= 1.5 * sum(sizes)


# --- packing -------------------------------------------------------------------------------------------------------


def test_fullest_is_the_best_subset():
    rng = random.Random(3)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(0, 90)
        reach = {0}
        for x, n in counts.items():
            reach = {s + x * k for s in reach for k in range(n + 1) if s + x * k <= room}
        got = packing.fullest(counts, room)
        assert sum(got) == max(reach)
        assert all(n <= counts[x] for x, n in Counter(got).items())


def test_plan_uses_every_item_and_few_bins():
    rng = random.Random(4)
    lengths = Counter(rng.randint(1, 1023) for _ in range(5000))
    steps = packing.plan(lengths)
    used = Counter()
    for times, combo in steps:
        assert sum(combo) <= 1024
        for x in combo:
            used[x] += times
    assert used == lengths
    bins = sum(t for t, _ in steps)
    least = max(-(-sum(x * n for x, n in lengths.items()) // 1024), sum(n for x, n in lengths.items() if x > 512))
    assert bins <= least * 1.005 + 1
    assert len(steps) <= 2 * 1024


def test_packed_pieces(odd, empty):
    got = packing.pack_documents(odd, with_ids=True).collect()
    encode = tokens.plain(tokens.vocabulary_path("byte_bpe_50k.json"))
    docs = Counter()
    for r in ODD:
        ids = [*encode.encode(r[1] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            raw = np.array(ids[a:b], dtype="<u4").tobytes()
            docs[(r[0], k, a, b - a, zlib.crc32(raw), bytes(raw))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got) == docs
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(empty).count() == 0
    whole = {r["sequence_id"]: len(r["ids"]) for r in packing.sequences(packing.pack_documents(odd, with_ids=True)).collect()}
    assert sum(whole.values()) == 4 * sum(r["length"] for r in got)


def test_fast_ids_are_those_of_the_tokenizers_file():
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json")), tokens.Encoder()
    assert list(fast("hi <|endoftext|> there")) == [5303, 220, 50256, 612]
    assert 50256 not in list(tokens.Encoder(special=False)("hi <|endoftext|> there"))
    texts = [r[1] or "" for r in ODD] + ["<|endoftext|>", "a<|endoftext|>b<|endoftext|", "<|endoftext|> it's   many\n\n  spaces\t\t", "x" * 3000, " " * 5000, "á‍﻿ 🏳️‍🌈 ١٢٣ ½ Ⅷ", "\x00\x1f\x7f"]
    for t in texts:
        assert list(fast(t)) == plain.encode(t, add_special_tokens=False).ids
        assert fast.decode(fast(t)) == t.encode()


# --- media ---------------------------------------------------------------------------------------------------------


def test_streams_hold_their_payload():
    for n in [*range(0, 1200, 7), 4608, 4609, 60_000, 200_001]:
        payload = media.padded(bytes((i * i) % 251 for i in range(n)))
        stream = media.mux(payload)
        read = media.demux(stream)
        assert len(stream) % 188 == 0 and read["payload"] == payload and read["errors"] == 0
        assert read["stamps"] == [i * media.TICKS for i in range(len(read["stamps"]))]
        assert read["access"] == list(range(0, len(read["stamps"]), media.GROUP))


def test_lost_packets_and_broken_tables_are_told():
    stream = media.mux(media.padded(bytes(20_000)))
    assert media.demux(stream[: 188 * 10] + stream[188 * 11 :])["errors"] >= 1
    broken = bytearray(stream)
    broken[10] ^= 1
    with pytest.raises(ValueError):
        media.demux(bytes(broken))


def test_media_of_odd_rows(odd, empty):
    got = media.features(media.stored(odd)).select("doc_id", "n_bytes", "_read.payload").collect()
    want = Counter((r[0], len((r[1] or "").encode()), hashlib.sha256(media.padded((r[1] or "").encode())).hexdigest()) for r in ODD)
    assert Counter((r["doc_id"], r["n_bytes"], hashlib.sha256(r["payload"]).hexdigest()) for r in got) == want
    assert media.features(media.stored(empty)).count() == 0
    none = odd.sparkSession.sql("SELECT CAST(NULL AS BINARY) AS media, 'x' AS _read UNION ALL SELECT X'', 'x'")
    assert sorted((r["_read"]["payload"], r["_read"]["packets"]) for r in media.features(none).collect() if r["media"] is not None) == [(b"", 0)]
    assert [tuple(r["_read"]) for r in media.features(none).collect() if r["media"] is None] == [(None,) * 6]


def test_streams_by_a_reader_of_its_own():
    """A second reader, written from the format: fixed packet ids, lengths from the headers, nothing of the module."""
    for n in (0, 1, 575, 576, 577, 5000, 70_000):
        payload = media.padded(bytes((7 * i) % 256 for i in range(n)))
        stream, units, starts, pts, random_access, counter = media.mux(payload), [], [], [], [], {}
        for k in range(len(stream) // 188):
            packet = stream[188 * k : 188 * k + 188]
            assert packet[0] == 0x47
            pid, flags, cc = int.from_bytes(packet[1:3], "big") & 0x1FFF, packet[3] >> 4 & 3, packet[3] & 15
            assert counter.get(pid, (cc - 1) & 15) == (cc - 1) & 15
            counter[pid] = cc
            body = packet[4:]
            rai = False
            if flags & 2:
                rai, body = bool(body[0] and body[1] & 0x40), body[1 + body[0] :]
            if pid != 0x100:
                continue
            if packet[1] & 0x40:
                starts.append(len(units))
                if rai:
                    random_access.append(len(units))
                units.append(b"")
            units[-1] += body
        out = b""
        for u in units:
            assert u[:4] == b"\0\0\1\xbd" and len(u) == 6 + int.from_bytes(u[4:6], "big") and u[7] >> 6 == 2
            bits = "".join(f"{x:08b}" for x in u[9:14])
            assert bits[7] == bits[23] == bits[39] == "1"
            pts.append(int(bits[4:7] + bits[8:23] + bits[24:39], 2))
            out += u[9 + u[8] :]
        assert out == payload and pts == [3600 * i for i in range(len(units))] and random_access == list(range(0, len(units), 12))


# --- language ------------------------------------------------------------------------------------------------------


def test_languages_are_told_apart(spark, make, odd, empty):
    rng = random.Random(6)
    parts = {"aa": ["ba", "ko", "tir"], "bb": ["sch", "ung", "eit"], "cc": ["eau", "tion", "ée"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(30)), "s", lang) for i, lang in enumerate(rng.choices(list(parts), k=300))]
    docs = make(rows)
    model = language_id.fit(docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "text"), per_lang=40)
    got = language_id.predict(docs.select("doc_id", "lang", "text"), model).select("lang", "_p.*").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 295
    assert all(0 <= r["score"] <= 1 for r in got)
    odd_got = language_id.predict(odd.select("doc_id", "text"), model).select("text", "_p.*").collect()
    assert len(odd_got) == len(ODD)
    for r in odd_got:
        assert (r["lang_pred"] == "und") == (r["text"] is None or not any(c.isalpha() for c in r["text"]))
    assert language_id.predict(empty.select("text"), model).count() == 0
    none = language_id.fit(empty.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "text"))
    assert {r[0] for r in language_id.predict(odd.select("text"), none).select("_p.lang_pred").collect()} == {"und"}


def test_null_and_repeated_ids_teach_every_language(spark):
    rng = random.Random(3)
    word = lambda parts: " ".join("".join(rng.choices(parts, k=3)) for _ in range(12))
    rows = [(None, "aa", word(["ba", "ko", "tir"])) for _ in range(2000)] + [(i, "bb", word(["sch", "ung", "eit"])) for i in range(2000)]
    rows += [(7, "cc", word(["eau", "tion", "que"])) for _ in range(1500)] + [(9, "dd", "xyz wvu xyz") for _ in range(1500)]
    docs = spark.createDataFrame(rows, "_id long, _lang string, text string")
    by = Counter(lang for lang, _, _ in language_id.sample(docs, 100))
    assert by == {"aa": 100, "bb": 100, "cc": 100, "dd": 100}
    assert set(language_id.fit(docs, per_lang=50).langs) == {"aa", "bb", "cc", "dd"}


def test_nearest_centroid_like_brute_force(make):
    """Scores by a plain evaluation of the model: trigrams counted one by one, cosines by sums."""
    rng = random.Random(11)
    docs = make([(i, " ".join("".join(rng.choices(["ba", "ko", "é", "sch"][i % 2 :: 2], k=3)) for _ in range(9)), "s", "ab"[i % 2]) for i in range(60)])
    model = language_id.fit(docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "text"), per_lang=20)
    for r in language_id.predict(docs.select("text"), model).collect():
        raw = " " + " ".join("".join(c if ord(c) > 127 or c.isalpha() else " " for c in r["text"].lower()).split()) + " "
        raw, tf = raw.encode(), Counter()
        for i in range(len(raw) - 2):
            tf[(int.from_bytes(raw[i : i + 3], "big") * 2654435761 % 2**32) >> 18] += 1
        x = {d: (1 + np.log(n)) * float(model.idf[d]) for d, n in tf.items()}
        norm = sum(v * v for v in x.values()) ** 0.5
        cos = [sum(v * float(c[d]) for d, v in x.items()) / norm for c in model.centroids]
        assert r["_p"]["score"] == pytest.approx(min(1, max(cos)), abs=1e-4)
        assert r["_p"]["lang_pred"] == model.langs[int(np.argmax(cos))]


def test_held_out_rows(spark):
    got = spark.range(200).select("id", language_id.held_out(F.col("id"), 5, 0).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


# --- quality classifier --------------------------------------------------------------------------------------------


def test_rules_find_what_makes_the_label(spark, make, odd, empty):
    rng = random.Random(7)
    rows = [(i, passage(i, 60) if (good := rng.random() < 0.7) else " ".join(w + "###" for w in passage(i, 60).split()), "s", str(int(good))) for i in range(400)]
    docs = make(rows)
    stats = quality_classifier.statistics(docs.select("doc_id", "text"))
    labels = docs.select(F.col("doc_id").alias("_id"), F.col("lang").cast("int").alias("_y"))
    model = quality_classifier.fit(stats.withColumnRenamed("doc_id", "_id"), labels)
    got = stats.select("doc_id", model.column().alias("s")).join(labels, F.col("doc_id") == F.col("_id")).collect()
    assert all((r["s"] >= 0.7) == (r["_y"] == 1) for r in got)
    assert model.describe()
    kept = quality_classifier.statistics(odd)
    assert kept.columns == [*odd.columns, *[f"f_{k}" for k in quality_classifier.FEATURES]] and {r["_m"] for r in kept.collect()} == {"extra"}
    some = stats.collect()[:80]
    for r, score in zip(some, [r["s"] for r in stats.select(model.column().alias("s")).collect()[:80]]):  # rule by rule
        total = model.intercept
        for rule, weight in model.rules:
            total += weight * all((r[f"f_{quality_classifier.FEATURES[f]}"] > bound) == above for f, above, bound in rule)
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    scores = quality_classifier.statistics(odd.select("text")).select(model.column().alias("s")).collect()
    assert len(scores) == len(ODD) and all(0 <= r["s"] <= 1 for r in scores)
    assert quality_classifier.statistics(empty.select("text")).count() == 0
    nothing = quality_classifier.fit(stats.withColumnRenamed("doc_id", "_id"), labels.limit(0))
    assert stats.select(nothing.column().alias("s")).first()["s"] == 0.5


# --- pages ---------------------------------------------------------------------------------------------------------


def test_warc_of_odd_pages(spark, tmp_path):
    from sextant.llm import warc

    html = ["<p>one</p>", "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n", None, "", "ünï 😀", "y" * 300_000]
    rows = [(i, None if i % 5 == 0 else f"http://h/{i}\n?q= {i}", html[i % 6], "extra") for i in range(40, 0, -1)] + [(7, "http://h/7", html[1], "x"), (None, "u", html[4], "x"), (None, None, "only", "x"), (1, "again", html[1], "x"), (1, "again", html[1], "x"), (None, None, "only", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _digest string")
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, records_per_file=7)
    got = warc.resolve(warc.read_archives(spark, path)).collect()
    want, seen = Counter(), {}
    for i, _, h, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (h or "").encode()
        kind = "revisit" if data in seen else "response"
        first = seen.setdefault(data, i)
        want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, first if kind == "revisit" else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    read = warc.read_archives(spark, path).collect()
    assert len({r["record_id"] for r in read}) == len(rows)
    pages.repartition(5).write.parquet(str(tmp_path / "pages"))
    warc.write_archives(spark.read.parquet(str(tmp_path / "pages")), str(tmp_path / "grouped"), as_read=True, most=1)
    got = warc.resolve(warc.read_archives(spark, str(tmp_path / "grouped"))).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    warc.write_archives(pages, str(tmp_path / "large"), min_bytes=100)
    kinds = Counter((r["record_type"], r["payload_bytes"] >= 100) for r in warc.resolve(warc.read_archives(spark, str(tmp_path / "large"))).collect())
    assert ("revisit", False) not in kinds and kinds[("revisit", True)]


def test_warc_of_no_pages(spark, tmp_path):
    from sextant.llm import warc

    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "none"))
    assert warc.resolve(warc.read_archives(spark, str(tmp_path / "none"))).count() == 0


# --- chat ----------------------------------------------------------------------------------------------------------


def test_escapes_are_undone_and_hide_marks():
    from sextant.llm import chat

    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice(["#", "##", "\\", "</turn>", "</", "turn>", " ", "x", "\n", ": ", "### A"]) for _ in range(rng.randint(0, 9)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert "###" not in safe and "</turn>" not in safe


def test_conversations_come_back(spark):
    from sextant.llm import chat

    odd = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "héllo 😀"), (1, 1, "assistant", "again"), (1, None, "system", None), (2, 5, None, ""), (2, 5, None, ""), (None, 0, "assistant", odd), (3, 0, "user", "w " * 30_000), (3, 1, "assistant", "<|endoftext|>")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, ids string, mask int")
    turns = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.read_conversations(turns).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert set(got) == set(by)
    for conv, own in by.items():
        assert got[conv]["n_turns"] == len(own)
        told = sorted(own, key=lambda r: (r[1] is not None, r[1] or 0))
        if len({r[1] for r in own}) == len(own):
            data = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in told)
            loss = "".join(r[3] or "" for r in told if r[2] == "assistant")
            assert got[conv]["turns_sha256"] == hashlib.sha256(data.encode()).hexdigest()
            assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    offsets = turns.groupBy("conv_id").agg(F.sum(F.length("mask")).alias("n"), F.max(F.struct("offset", F.length("mask").alias("l"))).alias("last")).collect()
    assert all(r["n"] == r["last"]["offset"] + r["last"]["l"] for r in offsets)
    assert chat.read_conversations(chat.format_conversations(df.limit(0))).count() == 0


def test_a_hot_conversation_is_split(spark):
    from sextant.llm import chat

    rows = [(1, i, ["user", "assistant"][i % 2], f"turn {i} ## </turn>") for i in range(4000)] + [(c, t, "assistant", f"{c} {t}") for c in [None, *range(2, 300)] for t in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(*turns.inputFiles()).filter("conv_id = 1").select("part").distinct().count() > 1
    hot = sorted((r["turn_no"], r["offset"], len(r["mask"])) for r in turns.filter("conv_id = 1").collect())
    assert [n for n, *_ in hot] == list(range(4000))
    assert all(a[1] + a[2] == b[1] for a, b in zip(hot, hot[1:])) and hot[0][1] == 0
    got = {r["conv_id"]: r for r in chat.read_conversations(turns).collect()}
    assert len(got) == 300 and got[None]["n_turns"] == 3
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 1).encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256("".join(t for c, _, r, t in rows if c == 1 and r == "assistant").encode()).hexdigest()


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stages_of_odd_rows(spark, odd, empty, tmp_path):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).count() == 0
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS and out.count() > 0
        assert stage(spark, odd.drop("lang"), str(tmp_path)).columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.pack(spark, empty, str(tmp_path)).count() == 0
    assert corpus_pipeline.pack(spark, odd, str(tmp_path)).count() >= len(ODD)


def test_pipeline_like_brute_force(spark, make, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    shared = passage(500, 70)
    rows = [(i, "\n".join(passage(i * 13 + k, rng.randint(20, 60)) for k in range(rng.randint(2, 5))), f"s{i % 4}") for i in range(40)]
    rows += [(100 + i, rows[i][1], "s1") for i in range(5)] + [(200 + i, passage(900 + i, 30) + "\n" + shared + "\n" + passage(950 + i, 60), "s2") for i in range(4)]
    rows += [(300, "too short", "s0"), (301, " | ".join(passage(7, 90).split()), "s0"), (302, None, None)]
    make(rows).select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, str(tmp_path)), "test-stage")
        assert docs.columns == corpus_pipeline.COLUMNS, name
        seen.append(docs.collect())
    base = {r[0]: base_of(r[1]) for r in rows}
    kept = [r for r in sorted(rows, key=lambda r: r[0]) if r[0] < 300 and base[r[0]][0] >= 50 and base[r[0]][4] * 2 <= base[r[0]][0]]
    assert len(kept) > 30
    assert {r["doc_id"] for r in seen[0]} == {r[0] for r in kept}
    texts, _ = dedup_brute([r[1] for r in kept], 50)
    want = {r[0]: t for r, t in zip(kept, texts) if split(t)}
    assert {r["doc_id"]: r["text"] for r in seen[1]} == want
    ids = sorted(want)
    comp = partition([simhash_dedup.fingerprint(want[i]) for i in ids], ids)
    assert {r["doc_id"] for r in seen[2]} == set(comp)
    total = sum(len(split(r["text"])) for r in seen[2])
    assert sum(len(split(r["text"])) for r in seen[3]) <= 1.5 * total
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encode = tokens.Encoder()
    assert sum(r["length"] for r in out) == sum(len(encode(r["text"])) + 1 for r in seen[3])
