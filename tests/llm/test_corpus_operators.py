"""What the operators do beyond the queries' digests."""

import base64
import json
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from sparkreef.llm import line_dedup, media, mixing, packing, quality, secrets, simhash, substring_dedup, toxicity, url_filter
from sparkreef.llm.components import components


def der(tag, *parts):
    body = b"".join(parts)
    size = len(body).to_bytes(2, "big")
    return bytes([tag, 0x82]) + size + body if len(body) > 127 else bytes([tag, len(body)]) + body


KEY = der(0x30, der(0x02, b"\0"), *(der(0x02, bytes(range(1, 60))) for _ in range(8)))


def test_secrets_are_confirmed_by_structure():
    jwt = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    fake = base64.urlsafe_b64encode(b'{"no":"header"}').decode().rstrip("=")
    b64 = base64.b64encode(KEY).decode()
    found = secrets.spans_of(f"{jwt}.abc.def {fake}.abc.def -----BEGIN RSA PRIVATE KEY-----\n{b64}\n-----END RSA PRIVATE KEY-----")
    assert [k for k, _, _ in found] == ["token", "pem"]
    assert [k for k, _, _ in secrets.spans_of(f"key {b64} end")] == ["der"]
    assert [k for k, _, _ in secrets.spans_of(f"key {b64[:-8]} end")] == []
    assert {k for k, _, _ in secrets.spans_of(f"hex {KEY.hex()} end")} == {"hex", "der"}
    assert secrets.spans_of("-----BEGIN PRIVATE KEY-----\nbm90IGEga2V5\n-----END PRIVATE KEY-----") == []


def string(data):
    return len(data).to_bytes(4, "big") + data


def openssh_key(cipher=b"none", kdf=b"none", options=b"", keys=1, kind=b"ssh-ed25519", check=b"abcdabcd"):
    public = string(kind) + string(bytes(range(32)))
    private = check + public + string(bytes(64)) + string(b"me@here")
    private += bytes(range(1, 1 + -len(private) % 8))
    return secrets.OPENSSH_MAGIC + b"".join(map(string, (cipher, kdf, options))) + keys.to_bytes(4, "big") + string(public) * keys + string(private)


def test_scanning_takes_time_in_proportion():
    """Lines that begin like keys, or like nothing, of which each could take all that follow."""
    import time

    lines = {"MQ": "MQ" + "A" * 62, "long": base64.b64encode(b"\x30\x82\x3f\xf0\x02\x01\x00\x30\x82\x3f\xe9" + bytes(37)).decode(), "unfit": base64.b64encode(b"\x30\x82\x3f\xf0\x02\x01\x00\x30\x83\x00\xff\xff" + bytes(36)).decode(), "ssh": base64.b64encode(secrets.OPENSSH_MAGIC + string(b"none") + string(b"none") + string(b"")[:2] + bytes(19)).decode()}
    for name, line in lines.items():
        text = (line + "\n") * (1_000_000 // (len(line) + 1))
        began = time.perf_counter()
        assert [k for k, _, _ in secrets.spans_of(text) if k not in secrets.BASE_KINDS] == []
        assert time.perf_counter() - began < (15 if name == "long" else 2), name


def test_secrets_in_other_clothes():
    """Upper-case hex, URL-safe and wrapped base64, PEM with header lines, SEC 1 keys of two fields."""
    kinds = lambda t: [k for k, _, _ in secrets.spans_of(t) if k not in secrets.BASE_KINDS]
    b64 = base64.b64encode(KEY).decode()
    wrapped = "\n".join(b64[i : i + 64] for i in range(0, len(b64), 64))
    assert kinds(f"HEX {KEY.hex().upper()} END") == kinds(f"key {base64.urlsafe_b64encode(KEY).decode()} end") == ["der"]
    text = f"my key:\n{wrapped}\nand more words after it"
    assert [(k, text[a:b]) for k, a, b in secrets.spans_of(text) if k == "der"] == [("der", wrapped)]
    assert kinds(f"{wrapped[:-6]}\n\nrest") == []
    small = der(0x30, der(0x02, b"\x01"), der(0x04, bytes(range(32))))
    assert kinds(base64.b64encode(small).decode()) == ["der"] and not secrets.is_key(der(0x30, der(0x02, b"\x01"), der(0x04, b"x")))
    sealed = der(0x30, der(0x30, der(0x06, b"\x2a\x86"), der(0x05)), der(0x04, bytes(64)))
    assert kinds(f"-----BEGIN ENCRYPTED PRIVATE KEY-----\n{base64.b64encode(sealed).decode()}\n-----END ENCRYPTED PRIVATE KEY-----") == ["pem"]
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
    body = base64.b64encode(bytes(range(160))).decode()
    pem = "-----BEGIN RSA PRIVATE KEY-----\n{}{}\n-----END RSA PRIVATE KEY-----"
    assert kinds(pem.format(head, body)) == ["pem"] and kinds(pem.format(head, body[:-8])) == kinds(pem.format("", body)) == []
    assert kinds(pem.format("Comment: mine\n", wrapped)) == ["pem"]
    key = openssh_key()
    ssh = base64.b64encode(key).decode()
    shown = "\n".join(ssh[i : i + 70] for i in range(0, len(ssh), 70))
    for text in (f"{shown}\nand words\n", f"  {shown}\n{'A' * 60}\n", ssh, f"{shown}"):
        assert [(k, text[a:b]) for k, a, b in secrets.spans_of(text) if k == "der"] == [("der", ssh if "\n" not in text else shown)]
    assert kinds(f"-----BEGIN OPENSSH PRIVATE KEY-----\n{shown}\n-----END OPENSSH PRIVATE KEY-----") == ["pem"]
    noise = random.Random(1).randbytes(300)
    fields = b"".join(string(x) for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big")
    for wrong in (key[:-8], key + bytes(8), secrets.OPENSSH_MAGIC + noise, secrets.OPENSSH_MAGIC + fields + noise, openssh_key(check=b"12345678"), openssh_key(kind=b"what")):
        told = base64.b64encode(wrong).decode()
        assert kinds("\n".join(told[i : i + 70] for i in range(0, len(told), 70))) == [] and not secrets.is_key(wrong)
    assert kinds(base64.b64encode(openssh_key(cipher=b"aes256-ctr", kdf=b"bcrypt", options=bytes(24), keys=2)).decode()) == ["der"]
    assert kinds(" ".join([pem.format("", "bm90IGEga2V5")] * 300)) == []


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_der_parser_takes_any_bytes(data):
    secrets.is_key(data)
    secrets.is_key(b"\x30" + data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60), st.sampled_from([4, 7, 16]))
def test_packing_places_each_token_once(lengths, window):
    done = packing.fill_gaps(packing.best_fit(lengths, window), window)
    held = {i: [] for i, n in enumerate(lengths) if n}
    for s in done:
        assert sum(n for _, _, n in s.pieces) <= window
        for doc, start, n in s.pieces:
            held[doc] += range(start, start + n)
    assert all(sorted(at) == list(range(lengths[i])) for i, at in held.items())
    short = [sum(n for _, _, n in s.pieces) for s in done]
    assert all(n == window or n & (n - 1) == 0 for n in short)


def test_best_fit_takes_the_tightest_window():
    sequences = packing.best_fit([6, 5, 4, 3, 2], 10)
    assert sorted(sorted(d for d, _, _ in s.pieces) for s in sequences) == [[0, 2], [1, 3, 4]]


def test_bitmaps_round_trip():
    keep = line_dedup.unpack_bitmap(line_dedup.pack_bitmap(11, [0, 3, 10]), 11)
    assert [i for i, k in enumerate(keep) if not k] == [0, 3, 10]


def test_tokens_of_special_strings_in_texts(spark):
    """A text may hold the vocabulary's special strings, alone or within words; ids are the plain encoding's."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    texts = ["<|endoftext|>", "a <|startoftext|> b", "abc<|endoftext|>def<|endoftext|>.", "<|endoftext|", "x<|endoftext|>,<|ENDOFTEXT|>", "  <|endoftext|>\t\n<|startoftext|><|endoftext|> "]
    rng = random.Random(8)
    texts += ["".join(rng.choice(["<|endoftext|>", "<|startoftext|>", "ab", " ", "é", ".", "|>", "<|", "\n", "İ", "7"]) for _ in range(30)) for _ in range(300)]
    docs = list(enumerate(texts))
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), path("word_bpe_49k.json"))
    rows = [tuple(r) for r in rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()]
    assert any(49407 in tokenizer.encode(t, add_special_tokens=False).ids for t in texts)
    assert brute.pieces(docs, rows, lambda t: tokenizer.encode(t, add_special_tokens=False).ids) is None


def test_dedup_lines_keeps_columns_and_rows(spark):
    rows = [(1, "a line that is long\nown one", "x"), (2, "A LINE that is long \nown", "y"), (3, None, "z")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, _keep string"))
    assert sorted(map(tuple, out.collect())) == [(1, rows[0][1], "x"), (2, "own", "y"), (3, None, "z")]


@pytest.mark.parametrize("crowd", [1, 3, 1 << 15])
def test_crowded_anchors_take_the_exact_other_way(spark, odd_docs, crowd):
    shared = "a passage which many documents have in common, with over fifty bytes to it. "
    docs = [(i, t) for i, t, *_ in odd_docs[:21]] + [(100 + i, f"{i} " * (i % 3) + shared + f"{i * 7919} and more") for i in range(12)]
    out = substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), crowd=crowd)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in out.collect()}
    assert found == brute.substrings(docs)


@pytest.mark.parametrize("crowd", [2, 1 << 15])
def test_passages_repeat_within_documents_too(spark, crowd):
    """Passages twice in a document, whole or in part, that smaller documents share in part."""
    rng = random.Random(21)
    made = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    docs = []
    for i in range(160):
        if i % 4 == 0:
            passages = [made(rng.randint(60, 400)) for _ in range(3)]
        parts = []
        for _ in range(rng.randint(1, 6)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p)))) if rng.random() < 0.5 else (0, len(p))
            parts += [p[a:b], made(rng.choice([0, 3, 40]))]
        docs.append((i, "".join(parts)))
    docs += [(200, docs[5][1] + made(9) + docs[5][1]), (201, docs[5][1][:90] + made(60) + docs[5][1][:120])]
    out = substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), crowd=crowd)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in out.collect()}
    assert found == brute.substrings(docs)


def test_rows_that_share_an_id_keep_their_own_spans(spark):
    """Of rows under one id none is first before another; a smaller id's passage goes from all of them."""
    rng = random.Random(22)
    made = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = made(200)
    rows = [(2, "x" + passage + made(5) + passage), (2, made(30) + passage[:150]), (1, made(20) + passage[:100]), (3, passage), (None, passage[40:])]
    out = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r.doc_id or 9, r.n_bytes, r.n_removed, r.n_spans) for r in out)
    sizes = sorted((i or 9, len(t)) for i, t in rows)
    assert [x[:2] for x in found] == sizes
    assert sorted(x[2:] for x in found if x[0] == 2) == [(100, 1), (200, 2)]
    assert [x[2] for x in found if x[0] in (1, 3, 9)] == [0, 200, 160]


@pytest.mark.parametrize("crowd", [2, 1 << 15])
def test_a_third_without_ids_and_an_id_that_many_share(spark, crowd):
    """Null and shared ids lose what smaller ids have, in each row by itself; rows that repeat alike."""
    rng = random.Random(23)
    made = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passages = [made(rng.randint(60, 300)) for _ in range(8)]
    text = lambda: "".join(rng.choice(passages)[rng.randint(0, 40) :] + made(rng.choice([0, 20])) for _ in range(rng.randint(0, 4)))
    rows = [(None if i % 3 == 0 else 50 if i % 3 == 1 else i, text()) for i in range(180)]
    rows += rows[:9] * 3
    out = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), crowd=crowd)
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in out.collect())
    assert found == Counter((i, *x) for (i, _), x in zip(rows, brute.substring_rows(rows), strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=90), min_size=1, max_size=8))
def test_anchors_of_many_texts_are_those_of_each(strings):
    """And each window has one anchor, which lies in it and at the same place in equal windows."""
    texts = substring_dedup.Texts([x.encode() for x in strings])
    text, keys, places, first, last = map(np.concatenate, zip(*(texts.anchors(i, j, 20, 8) for i, j in texts.pieces()), strict=True))
    alone = [substring_dedup.anchors(np.frombuffer(x.encode(), np.uint8), 20, 8) for x in strings]
    for i, found in enumerate(zip(keys, places, first, last, strict=True)):
        assert [int(x) for x in found[1:]] == [int(x[sum(text[:i] == text[i])] + texts.start[text[i]]) for x in (alone[text[i]][k] for k in (0, 2, 3))]
    assert len(text) == sum(len(x[0]) for x in alone)
    of = {w: p for p, a, b in zip(places, first, last, strict=True) for w in range(a, b + 1)}
    windows = [int(s) + k for s, x in zip(texts.start, strings, strict=True) for k in range(len(x) - 19)]
    assert sorted(of) == windows and sum(last - first + 1) == len(windows)
    assert all(w <= of[w] <= w + 12 for w in windows)
    assert len({(texts.raw[w : w + 20], of[w] - w) for w in windows}) == len({texts.raw[w : w + 20] for w in windows})


def test_long_runs_of_one_byte_take_no_step_each():
    text = np.full(1_000_000, ord("="), np.uint8)
    began = time.thread_time()
    places, _, first, last = substring_dedup.anchors(text, 50, 16)
    assert time.thread_time() - began < 5
    assert int((last - first + 1).sum()) == len(text) - 49 and len(places) == len(text) - 49


def test_contexts_are_settled_by_their_bytes(monkeypatch):
    """Hashes only gather contexts: where all of them collide, those with other bytes are not settled."""
    passage = "".join(random.Random(24).choice("abcdefghijklmnop ") for _ in range(400))
    raws = [("x" * 60 + passage).encode(), ("y" * 60 + passage + "z" * 60).encode()]
    shared = [np.unique(substring_dedup.anchors(np.frombuffer(x, np.uint8), 50, 16)[1]) for x in raws]
    wanted = np.concatenate([substring_dedup.of_text(np.full(len(x), i), x) for i, x in enumerate(shared)])
    late = []
    for hashes in (substring_dedup.spread_hashes, lambda data, start, end: np.zeros(len(start), np.uint64)):
        monkeypatch.setattr(substring_dedup, "spread_hashes", hashes)
        found = substring_dedup._Contexts(raws, wanted, np.zeros(len(wanted), bool), 50, 16)
        late.append(found.late(found.text))
        kinds = list(zip(found.key.tolist(), found.left.tolist(), (found.texts.raw[a:b] for a, b in zip(found.begin, found.end, strict=True)), strict=True))
        before = {k for k, t in zip(kinds, found.text, strict=True) if t == 0}
        assert all(k in before and t == 1 for k, t, x in zip(kinds, found.text, late[-1], strict=True) if x)
    assert late[0].any()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=12), min_size=1, max_size=12))
def test_suffix_sort_orders_strings(strings):
    data = np.frombuffer("".join(strings).encode() + b"z", np.uint8)
    sizes = np.array([len(s) for s in strings])
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    order = substring_dedup.Suffixes(data).sort(start, sizes, np.zeros(len(strings), np.int64))
    assert [strings[i] for i in order] == sorted(strings)


def test_components_of_links(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1064)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: find(x) for x in root}


def near(text, rng, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def similarity(a, b):
    runs = lambda t: set(simhash.shingles(t, 5))
    return len(runs(a) & runs(b)) / max(1, len(runs(a) | runs(b)))


def test_near_copies_are_found_and_others_left(spark):
    rng = random.Random(11)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(60)]
    docs, wanted = [], {}
    for g, text in enumerate(base):
        for copy in range(4):
            docs.append((len(docs), near(text, rng, 4) if copy else text, "s"))
            wanted[len(docs) - 1] = 4 * g
    docs.append((len(docs), None, "s"))
    kept = simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    assert kept.columns == ["doc_id", "text", "source"]
    left = {r.doc_id for r in kept.collect()}
    assert {i for i, g in wanted.items() if i == g} <= left
    close = [i for i, g in wanted.items() if i != g and similarity(docs[i][1], docs[g][1]) >= 0.82]
    assert len(close) > 150
    assert sum(i in left for i in close) <= 0.03 * len(close)


def near_copy_groups(rows, least=0.8):
    """The indices of ``rows`` (id, text, ...) by group, every pair compared."""
    sets = [frozenset(simhash.shingles(r[1], 5)) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= least * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def test_near_copies_without_ids_of_their_own(spark, repeated):
    """Null ids, and an id that different texts share: one row of each group stays."""
    docs = spark.read.parquet(f"{repeated}/documents.parquet")
    rng = random.Random(12)
    more = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(50)), None, None, 0) for i in [None] * 6 + [7] * 6]
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, docs.schema[:5]))
    rows = [tuple(r) for r in docs.collect()]
    kept = [tuple(r) for r in simhash.drop_near_copies(docs).collect()]
    place = lambda r: (r[0] is None, r[0] or 0)
    groups = near_copy_groups(rows)
    assert len(kept) == len(groups)
    for group in groups:
        members = [rows[i] for i in group]
        stays = [r for r in kept if r in members]
        assert len(stays) == 1 and place(stays[0]) == min(map(place, members))


def test_near_copies_are_told_by_their_whole_sets(spark):
    """Pairs a little under the threshold stay, those at it or above it go (a few may not meet)."""
    rng = random.Random(13)
    docs, under, over = [], [], []
    for g in range(150):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))
        copy = near(text, rng, rng.randint(8, 11))
        docs += [(2 * g, text), (2 * g + 1, copy)]
        s = similarity(text, copy)
        (under if 0.74 <= s < 0.8 else over if 0.8 <= s < 0.84 else []).append(2 * g + 1)
    left = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(under) > 30 and len(over) > 30
    assert left.issuperset(under)
    assert len(left.intersection(over)) <= 0.1 * len(over)


def test_near_copies_within_a_hot_family(spark):
    """Hundreds of texts share a template; those at 0.8 and more are found as by brute force."""
    rng = random.Random(14)
    word = lambda: f"w{rng.randrange(10**6)}"
    template, docs = [word() for _ in range(200)], []
    for _ in range(250):
        text = " ".join(template + [word() for _ in range(rng.randint(70, 140))])
        docs.append((len(docs), text))
        if len(docs) % 2:
            docs.append((len(docs), near(text, rng, rng.randint(4, 8))))
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    groups = near_copy_groups(docs)
    assert sum(len(g) > 1 for g in groups) > 30 and len(groups) > 250
    assert kept == {min(g) for g in groups}


def test_near_copies_that_meet_late(spark):
    """A text and many copies of it that are alike only through it are one group."""
    rng = random.Random(15)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))
    docs = [(i, near(text, rng, 7)) for i in range(40)] + [(40, text)] + [(41 + i, near(text, rng, 12)) for i in range(20)]
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {min(g) for g in near_copy_groups(docs)}


def test_overlapping_sources_share_by_flow(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * 1 for _ in range(rng.randint(1, 40))), rng.choice([["a"], ["b"], ["a", "b"], ["b", "c"], [], None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    found = mixing.mix_sources(docs).collect()
    taken = {"a": 0, "b": 0, "c": 0}
    quota = {}
    for r in found:
        assert r.taken == r.repeats * r.size <= 2 * r.size and len(r.routes) == r.repeats and set(r.routes) <= set(r.sources)
        for s in r.routes:
            taken[s] += r.size
        quota |= {q.source: q.target for q in r.quotas}
    for s, q in quota.items():
        assert abs(taken[s] - q) <= 200


def test_min_cost_flow_avoids_repetition():
    routed = mixing.route({("a",): 10, ("a", "b"): 10}, {"a": 10.0, "b": 10.0}, 2)
    assert routed[("a",)] == {"a": 10} and routed[("a", "b")] == {"a": 0, "b": 10}


def test_fences_follow_the_group(spark):
    rng = random.Random(1)
    plain = lambda marks: " ".join(rng.choice("abcdefgh") * rng.randint(3, 7) + "#" * marks for _ in range(80))
    rows = [(i, plain(1 if s == "noisy" else 0), "en", s) for i, s in enumerate(["noisy", "clean"] * 300)]
    rows += [(9001, plain(1), "en", "noisy"), (9002, plain(1), "en", "clean")]
    out = quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    verdict = {r.doc_id: (r.kept, r.beyond) for r in out.where("doc_id > 9000").collect()}
    assert verdict == {9001: (True, []), 9002: (False, ["symbols"])}


def test_fences_of_values_without_an_upper_end(spark):
    """Mean word lengths over 100 characters are measured as they are, and fenced."""
    rows = [(i, " ".join(f"{i}-{j}".ljust(150 + (i * 7 + j) % 5, "x") for j in range(60)), "en", "s") for i in range(300)]
    rows += [(9001, " ".join(f"{j}".ljust(700, "y") for j in range(60)), "en", "s"), (9002, " ".join(f"{j}".ljust(153, "y") for j in range(60)), "en", "s")]
    out = quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {r.doc_id: (r.kept, r.beyond) for r in out.where("doc_id > 9000").collect()} == {9001: (False, ["word_length"]), 9002: (True, [])}
    assert out.where("kept").count() == 301


def test_sketch_steps_are_close(spark):
    values = [0, 1, 1023, 1024, 1025, 1026, 2047, 2048, 5000, 123_456_789, 2**62 + 12345]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.step(F.col("v")).alias("s"))
    for v, s in df.collect():
        assert s <= v and v - s <= v / 512 and (v >= 1024 or s == v)


def test_sketches_merge(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts = quality.text_counts(docs, keep=("lang", "source"))
    whole = {(r.measure, r.value): r.n for r in quality.sketch(counts, []).collect()}
    merged = {(r.measure, r.value): r.n for r in quality.merged(quality.sketch(counts, ["lang", "source"]), []).collect()}
    assert whole == merged


def test_mined_rules_judge_what_the_list_leaves(spark):
    rows = [(i, f"http://h{i % 9}.net/{'casino' if i % 3 == 0 else 'news'}/{i}", "block" if i % 3 == 0 else "allow") for i in range(300)]
    labels = spark.createDataFrame(rows, "n long, url string, label string")
    pages = spark.createDataFrame([(1, "http://x.net/casino/5"), (2, "http://x.net/news/5"), (3, None)], "page_id long, url string")
    verdict = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, labels).collect()}
    assert verdict == {1: "block", 2: "allow", 3: "allow"}


def test_deep_urls_are_matched_by_all_their_tokens(spark):
    """What tells may stand in the eighth segment, the sixth label or the fifth key."""
    deep = lambda i, word: f"http://a.b.c.{'x' if i % 2 else 'y'}.h{i % 5}.net/1/s/t/u/v/w/{'p' if i % 3 else 'q'}/{word}?a=1&b=2&c=3&d=4&{'bad' if word == 'spam' else 'ok'}=5"
    rows = [(i, deep(i, "spam" if i % 4 == 0 else "text"), "block" if i % 4 == 0 else "allow") for i in range(400)]
    labels = spark.createDataFrame(rows, "n long, url string, label string")
    pages = [(1, "http://other.net/1/s/t/u/v/w/z/spam"), (2, "http://other.net/9?q=1&r=2&s=3&t=4&bad=1"), (3, "http://other.net/1/s/t/u/v/w/z/text")]
    verdict = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()}
    assert verdict == {1: "block", 2: "block", 3: "allow"}


def test_mix_of_very_many_sources(spark):
    """50,000 sources of one document each, and hot ones: targets as by plain computation."""
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), F.concat(F.lit("host"), "id").alias("source"))
    more = spark.range(3000).select((F.col("id") + 100_000).alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 2 == 0, "hot").alias("source"))
    found = mixing.mix_report(docs.union(more)).withColumn("short", F.col("taken") - F.col("target"))
    sources = docs.union(more).groupBy("source").agg(F.sum(mixing.word_count()).alias("size")).collect()
    wanted = brute.targets({r.source: r.size for r in sources})
    rows = found.join(docs.union(more).select("doc_id", "source"), "doc_id").collect()
    assert len(rows) == 53_000 and all(r.taken <= 2 * r.size and r.target == pytest.approx(wanted[r.source], abs=1e-6) for r in rows)
    hot = [r for r in rows if r.source in ("hot", None)]
    for s in ("hot", None):
        assert abs(sum(r.taken for r in hot if r.source == s) - wanted[s]) <= 4


def melody(seed, n):
    rng = np.random.RandomState(seed)
    return rng.uniform(-0.3, 0.3, n).tolist()


def test_recordings_align_at_their_offset(spark):
    tune = melody(1, 64)
    rows = [(1, tune), (2, tune[16:]), (3, melody(2, 64)), (4, None), (5, []), (6, tune), (None, tune)]
    found = {r.vec_id: r for r in media.align_recordings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", media.from_notes).collect()}
    assert found[2].class_id == 1 and found[2].partner_id == 1 and found[2].bit_error < 0.1
    assert found[1].partner_id == 2 and found[1].offset == -found[2].offset == 43  # 16 notes of 689 samples, in steps of 256
    assert found[6][1:] == found[None][1:] == found[1][1:]
    assert found[3].class_id == 3 and found[4].n_prints == 0 and found[5].class_id == 5 and found[5].partner_id is None


def sounds(rng, n):
    """Melodies as samples, with noisy, cut and faster sampled versions of them, and some that only share a jingle."""
    jingle, rows = melody(99, 40), []
    for i in range(n):
        tune, rate = media.from_notes(melody(i, 64))
        rows += [(tune, rate), (tune[int(rng.uniform(0.05, 0.4) * len(tune)) :] + rng.normal(0, 0.2), rate)]
        noisy = tune + rng.normal(0, rng.uniform(0.05, 0.3), len(tune))
        rows += [(noisy[int(rng.integers(0, 2000)) :], rate), (np.repeat(tune, 2), 2 * rate), media.from_notes(melody(1000 + i, 64))]
        if i % 3 == 0:
            rows.append(media.from_notes(melody(2000 + i, 40) + jingle))
    return rows


def test_recordings_align_as_by_brute_force(spark):
    """Classes are those of all pairs that align, whether they share a landmark or not."""
    rng = np.random.default_rng(3)
    rows = [(i, (s * 8000).clip(-32768, 32767).astype("<i2").tobytes(), r) for i, (s, r) in enumerate(sounds(rng, 12))]
    decode = lambda b: (np.frombuffer(b[4:], "<i2") / 8000, int.from_bytes(b[:4], "little"))
    df = spark.createDataFrame([(i, bytearray(r.to_bytes(4, "little") + b)) for i, b, r in rows], "id long, sound binary")
    found = {r.id: r for r in media.align_recordings(df, "id", "sound", decode).collect()}
    prints = [media.packed(media.chroma(media.resampled(np.frombuffer(b, "<i2") / 8000, r))) for _, b, r in rows]
    root, pairs = list(range(len(rows))), 0

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, one in enumerate(prints):
        for j, two in enumerate(prints[:i]):
            errors = [e for o in range(media.SPAN - len(two), len(one) - media.SPAN + 1) if (e := media.bit_error(one, two, o)) is not None]
            if min(errors, default=1) <= media.MOST_ERROR:
                pairs += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    wanted = [find(i) for i in range(len(rows))]
    assert pairs > 60 and len(set(wanted)) < len(rows) / 2
    assert np.mean([found[i].class_id == w for i, w in enumerate(wanted)]) >= 0.95
    for i, r in found.items():
        if r.partner_id is not None:
            assert wanted[i] == wanted[r.partner_id]
            assert media.bit_error(prints[i], prints[r.partner_id], r.offset) == pytest.approx(r.bit_error)


def test_frames_are_transformed_in_bounded_memory():
    """A long recording's spectra are never held at once, and its frames are those of one transform."""
    tune = np.tile(media.from_notes(melody(5, 64))[0], 12)[:500_000]
    media.chroma(tune[:5000])
    tracemalloc.start()
    found = media.chroma(tune)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000
    frames = np.lib.stride_tricks.sliding_window_view(tune, media.FRAME)[:: media.STEP] * np.hanning(media.FRAME)
    power = np.abs(np.fft.rfft(frames)) ** 2
    hertz = np.fft.rfftfreq(media.FRAME, 1 / media.RATE)
    of = [int(round(12 * np.log2(h / 440))) % 12 if media.LOW <= h <= media.HIGH else 12 for h in hertz]
    whole = np.stack([power[:, [i for i, c in enumerate(of) if c == k]].sum(1) for k in range(12)], 1)
    assert np.allclose(found, whole / np.sqrt((whole**2).sum(1, keepdims=True)))


def test_toxicity_separates_what_it_has_learnt():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    bad = ["zzyzxql", "qwvxkku", "xxyyzzq"]
    texts = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(400)]
    labels = [i % 4 == 0 for i in range(400)]
    texts = [t + " " + " ".join(rng.choices(bad, k=12)) if y else t for t, y in zip(texts, labels, strict=True)]
    model = toxicity.fit(texts[:300], list(map(int, labels[:300])))
    pair = model.compressors()
    scores = model.score(np.array([toxicity.features_of(toxicity.gains(toxicity.words_of(t), *pair)) for t in texts[300:]]))
    assert min(s for s, y in zip(scores, labels[300:], strict=True) if y) > 0.7 > max(s for s, y in zip(scores, labels[300:], strict=True) if not y)


def test_toxicity_on_held_out_rows(spark, large):
    from sparkreef.llm.queries import QUERIES

    scored = QUERIES["op4_toxicity_dictionaries"](spark, large).where("held_out")
    rows = scored.join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").select("score", F.col("toxic").alias("y")).collect()
    one, two = [r.score for r in rows if r.y], [r.score for r in rows if not r.y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in one for b in two])
    assert len(one) > 100 and auc >= 0.9 and np.mean([b < 0.7 for b in two]) > 0.96 and np.mean([a >= 0.7 for a in one]) > 0.65


def test_toxicity_scores_are_for_fixed_odds():
    """Texts that say nothing score alike, whatever the sample's share of toxic ones."""
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["some", "plain", "words", "and", "more"]) for _ in range(30))
    for n in (30, 90, 270):
        model = toxicity.fit([text() for _ in range(n + 90)], [1] * n + [0] * 90)
        pair = model.compressors()
        scores = model.score(np.array([toxicity.features_of(toxicity.gains(toxicity.words_of(text()), *pair)) for _ in range(40)]))
        assert abs(np.median(scores) - toxicity.ODDS / (1 + toxicity.ODDS)) < 0.12


def test_training_texts_are_bounded(spark, monkeypatch):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, "".join(rng.choice("abcdef ") for _ in range(100))) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "MOST_TOTAL", 2000)
    monkeypatch.setattr(toxicity, "fit", lambda texts, marks: seen.append((sum(map(len, texts)), sorted(marks))))
    toxicity.train(docs, labels)
    assert seen == [(2000, [0] * 10 + [1] * 10)]


def test_near_copies_are_candidates_by_fingerprints(spark, monkeypatch):
    """The stage's candidates come by SimHash and pivots; with no others from the first meeting they still link copies."""
    text = " ".join(f"w{i}" for i in range(400))
    docs = [(1, text), (2, text + " more"), (3, " ".join(f"v{i}" for i in range(300)))]
    asked = []
    found = simhash.fingerprint_pairs
    monkeypatch.setattr(simhash, "fingerprint_pairs", lambda marked: asked.append(1) or found(marked))
    groups = simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string"))
    assert asked and len({r.component_id for r in groups.collect()}) == 2
    marked = spark.createDataFrame([(5, 0), (6, 0), (7, 3), (8, 7), (9, -1)], "node long, fp long")
    pairs = {tuple(r) for r in found(marked).collect()}  # links span the groups, so that 8 has one of its group
    assert pairs >= {(5, 6), (5, 7)} and {x for r in pairs for x in r} == {5, 6, 7, 8}
