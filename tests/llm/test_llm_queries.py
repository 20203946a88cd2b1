"""The registered queries on a driver table, against brute force, an exact round trip or held-out accuracy."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from support import DATA
from test_documents import partition

import __spark_entry__
from sextant.llm import media, simhash_dedup, tokens

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: __spark_entry__.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def test_media(run, docs):
    got = {r["doc_id"]: r for r in run("op2_media")}
    assert len(got) == len(docs)
    for d in docs.itertuples():
        data = (d.text or "").encode()
        payload, stream = media.padded(data), media.mux(media.padded(data))
        r = got[d.doc_id]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-32:]), len(stream), hashlib.sha256(stream).hexdigest())
        assert "errors=0" in r["feature"] and len(r["random_access"]) == len(r["access_pts"])
    assert len({(r["media_sha256"], r["feature"]) for r in got.values()}) == docs.text.fillna("").nunique()


def test_language(run, docs):
    got = {r["doc_id"]: r for r in run("op3_language_id")}
    assert set(got) == set(docs.doc_id)
    held = [d for d in docs.itertuples() if zlib.crc32(str(d.doc_id).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == {d.doc_id for d in held}
    assert np.mean([got[d.doc_id]["lang_pred"] == d.lang for d in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_chat(run):
    odd = r"\### Assistant: </turn> ok"
    rows = pd.read_parquet(f"{SF}/conversations.parquet").sort_values(["conv_id", "turn"])
    turns = defaultdict(list, {-7: [("user", odd), ("assistant", odd)]})
    for r in rows.itertuples():
        turns[r.conv_id].append((r.role, r.text or ""))
    got = {r["conv_id"]: r for r in run("op5_chat")}
    assert set(got) == set(turns)
    for conv, own in turns.items():
        loss = "".join(t for role, t in own if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] >= sum(len(a) + len(b) for a, b in own) + 14 * len(own)


def test_packing(run, docs):
    encode = tokens.plain(tokens.vocabulary_path("byte_bpe_50k.json"))
    got, want, total = run("op7_packing"), Counter(), 0
    for d in docs.itertuples():
        ids = np.array([*encode.encode(d.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        total += len(ids)
        want.update((d.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *[n for _, n in own]])[:-1]) and sum(n for _, n in own) <= 1024
    assert len(bins) <= total / 1024 * 1.05 + 2


def test_warc(run):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    same = defaultdict(list)
    for p in pages.itertuples():
        same[p.html or ""].append(p.page_id)
    want = set()
    for html, ids in same.items():
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        want |= {(i, len(html.encode()), digest, "response" if i == min(ids) else "revisit", None if i == min(ids) else min(ids)) for i in ids}
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in run("op8_warc")} == want


def test_quality(run, docs):
    got = {r["doc_id"]: r for r in run("op9_quality_classifier")}
    assert set(got) == set(docs.doc_id)
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    held = [(r.quality, got[r.doc_id]) for r in labels.itertuples() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r["held_out"] for _, r in held) and held
    good, bad = [r["score"] for y, r in held if y == 1], [r["score"] for y, r in held if y == 0]
    assert np.mean([a > b for a in good for b in bad]) >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_near_duplicates(run, docs):
    fps = [simhash_dedup.fingerprint(t) for t in docs.text]
    want = {i: (f"{f:016x}", c) for i, f, c in zip(docs.doc_id, fps, partition(fps, list(docs.doc_id)))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run("op10_simhash_dedup")} == want
