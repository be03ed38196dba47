"""The ten operators and the pipeline: SQL or brute force on small tables, and the cases every operator must define."""

import importlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, same_as_sql
from weftline import llm

from weftline.llm.decontaminate import decontaminate, find_windows
from weftline.llm.exact_dedup import combine, exact_dedup, fingerprint
from weftline.llm.language_id import UNDETERMINED, NgramVectors, fit, identify, is_held_out
from weftline.llm.license_scan import differences, findings, license_scan, ranked, TEMPLATES
from weftline.llm.line_dedup import line_dedup
from weftline.llm.lm_score import Network, lm_score, train, word_keys
from weftline.llm.ngram_join import choose_prefix, keep_one, near_groups
from weftline.llm.packing import difference, pack, pack_documents
from weftline.llm.secret_scan import CLASSES, secret_scan, spelled
from weftline.llm.shingles import most_common, set_bits, shingle_sets, word_hashes
from weftline.llm.token_files import decode_ranks, encode_ranks, read_tokens, token_folder, write_tokens
from weftline.llm.tokens import WORD_VOCABULARY, encoder

q = importlib.import_module("weftline.llm.registered")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = "doc_id long, text string, spans string, n_lines string, hits string, __x int"


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", None) for i, t in enumerate(texts)], SCHEMA)


def odd_docs(spark):
    """Nulls, empties, a repeated row, a null id, and columns whose names operators use themselves."""
    rows = [(1, "a b c d e f", "x", "y", "z", 1), (1, "a b c d e f", "x", "y", "z", 1), (2, None, None, None, None, None), (None, "a b c d e f", "x", "y", "z", 2), (3, "", "", "", "", 3)]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="module")
def corpus(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_against_sql(spark, db, name):
    same_as_sql(spark, db, q.QUERIES[name], q.ORACLES[name])


def test_names():
    assert [re.match(r"op(\d+)_", n)[1] for n in sorted(llm.queries(), key=lambda n: int(re.match(r"op(\d+)", n)[1]))] == [str(i) for i in range(1, 11)]


# --- 1: token files ----------------------------------------------------------------------------------------------------


def test_rank_coding():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (2 ** rng.uniform(0, 32, n)).astype(np.uint64).astype(np.uint32)
        assert np.array_equal(decode_ranks(*encode_ranks(ranks), n), ranks)
    edges = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32)
    control, data = encode_ranks(edges)
    assert np.array_equal(decode_ranks(control, data, 8), edges) and len(control) == 2 and len(data) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4


def test_encoder_equals_library():
    tok, rng = encoder(WORD_VOCABULARY), random.Random(3)
    letters = "abcABC éÉñß'sS'tT'll ve ,.;:!?_-()<>|0123 \n\t\r\x0b\xa0“—…™²ªİıſK€漢🙂Σς\x1c\x85\xad"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["<|endoftext|> x", None, "x" * 300 + " y"]
    for text, ids in zip(texts, tok.documents(texts), strict=True):
        assert ids.tolist() == tok.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def library_ids(texts):
    tok = encoder(WORD_VOCABULARY).tokenizer
    return [np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], np.uint32) for t in texts]


def test_encoder_tells_strings_apart():
    """Words that a polynomial hash takes for equal, and strings that share the hash of the table itself."""
    tokens = importlib.import_module("weftline.llm.tokens")
    word = morse(1024)
    texts = [word, word.translate(str.maketrans("ab", "ba")), f"{morse(16)} {morse(32)[16:]} {morse(17)}", "x" * 200_000, " ".join(["é" * n for n in range(1, 20)])]
    want = [list(x) for x in library_ids(texts)]
    enc = tokens.TextEncoder(tokens.WORD_VOCABULARY, 1000)
    for _ in range(2):
        assert [list(x) for x in enc.documents(texts)] == want
    # low, high and low2, high2 with mix(low) + high = mix(low2) + high2: one hash for two strings
    from weftline.llm.shingles import mix

    rng, pairs = np.random.default_rng(4), []
    while len(pairs) < 3:
        a, b, h = (rng.integers(1, 256, (4096, 8)).astype(np.uint8).view("<u8").ravel() for _ in range(3))
        g = mix(a) + h - mix(b)
        ok = np.flatnonzero((g.view(np.uint8).reshape(-1, 8) != 0).all(axis=1))
        pairs += [(a[i].tobytes() + h[i].tobytes(), b[i].tobytes() + g[i].tobytes()) for i in ok[:3]]
    memo, strings = tokens.Memo(), [x for p in pairs for x in p]
    spelt = tokens.joined(strings)
    assert len(set(memo._spelt(spelt)[2].tolist())) == len(pairs)
    memo.add(spelt, np.arange(len(strings), dtype=np.uint32), np.arange(1, len(strings) + 1))
    assert memo.ids(memo.find(spelt))[0].tolist() == list(range(len(strings)))
    unknown = tokens.joined([b"q" * 16, b"q" * 17, pairs[0][0][:15]])
    assert memo.find(unknown).tolist() == [-1, -1, -1]


def test_token_files(spark, corpus):
    ids = dict(zip((d for d, _ in corpus), library_ids([t for _, t in corpus]), strict=True))
    at, want = 0, set()
    for d in sorted(ids):
        want.add((d, at, len(ids[d]), zlib.crc32(ids[d].tobytes())))
        at += len(ids[d])
    assert {tuple(r) for r in q.op1_token_binary(spark, SF).collect()} == want


def test_token_files_edges(spark):
    folder = token_folder(spark)
    rows = sorted((tuple(r) for r in read_tokens(spark, folder, write_tokens(odd_docs(spark), folder)).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == [None, 1, 1, 2, 3] and [r[1] for r in rows] == [0, 7, 14, 21, 22]
    folder = token_folder(spark)
    assert read_tokens(spark, folder, write_tokens(odd_docs(spark).limit(0), folder)).count() == 0


# --- 2: lines -------------------------------------------------------------------------------------------------------------


def test_line_dedup_long(spark):
    """A hundred thousand frequent lines in a text take no time to speak of."""
    texts = ["\n".join([f"line {j}" for j in range(100_000)] + [f"own {i}", "line 5 "]) for i in range(10)]
    assert [(r.text, r.n_lines, r.n_dropped) for r in line_dedup(docs_of(spark, texts)).orderBy("doc_id").collect()] == [(f"own {i}", 100_002, 100_001) for i in range(10)]


def test_line_dedup_edges(spark):
    texts = [f"Keep {i}\n  COMMON line\t\n\nÉ x" for i in range(3)] + ["common LINE", None, "", "é x"]
    out = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup(docs_of(spark, texts), min_docs=4).collect()}
    assert out[0] == ("Keep 0\n\nÉ x", 4, 1) and out[3] == ("", 1, 1) and out[4] == ("", 1, 0) and out[5] == ("", 1, 0) and out[6] == ("é x", 1, 0)
    # a document counts once for a line that it repeats; repeated rows are documents
    assert {r.n_dropped for r in line_dedup(docs_of(spark, ["a\na\na", "a"]), min_docs=3).collect()} == {0}
    odd = line_dedup(odd_docs(spark), min_docs=3)
    assert odd.columns == ["doc_id", "text", "spans", "hits", "__x", "n_lines", "n_dropped"] and sorted(r.n_dropped for r in odd.collect()) == [0, 0, 1, 1, 1]
    assert line_dedup(odd_docs(spark).limit(0)).count() == 0


# --- 3: languages -----------------------------------------------------------------------------------------------------------


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = q.op3_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out and r.lang]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)


def test_language_vectors_and_edges(spark):
    v = NgramVectors.get()
    a, b, c = (v.placed[2][i].astype(int) for i in (1, 2, 3))
    assert v.ngrams("abc").tolist() == [0 * 4096 + 1 * 64 + 2, 1 * 4096 + 2 * 64 + 3, 2 * 4096 + 3 * 64 + 0]
    assert np.array_equal(v.bundle(v.ngrams("abc")[1:2]), np.roll(a, 2) * np.roll(b, 1) * c)
    profiles = fit(spark.createDataFrame([("the cat", "en"), ("der hund", "de"), (None, "fr"), ("x", None), ("123", "num")], "text string, lang string"))
    assert profiles.names == ("de", "en")
    df = spark.createDataFrame([(1, "the cat", "k"), (2, None, None), (3, "12 !", "k"), (None, "der hund", "k"), (5, "漢字", "k")], "doc_id long, text string, score string")
    got = identify(df, profiles).collect()
    assert [r.lang_pred for r in got][:4] == ["en", UNDETERMINED, UNDETERMINED, "de"] and [r.score for r in got][1:3] == [0.0, 0.0]
    assert identify(df.limit(0), profiles).count() == 0 and df.where(is_held_out()).count() >= 0
    assert {r.lang_pred for r in identify(df, fit(df.withColumn("lang", F.lit(None).cast("string")))).collect()} == {UNDETERMINED}


# --- 4: packing ---------------------------------------------------------------------------------------------------------------


def check_packing(rows, ids, capacity=2048):
    cover, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and len(ids[r.doc_id]) == r.doc_tokens and r.length > 0
        cover[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))

    def total(parts):
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        return at

    assert {d: total(v) for d, v in cover.items()} == {d: len(x) for d, x in ids.items()}
    sums = [total(v) for v in sequences.values()]
    assert max(sums) <= capacity
    return sum(sums) / capacity / len(sums)


def test_packing(spark, corpus):
    """Little padding even in batches of some fifty documents, and only documents longer than a window are cut."""
    ids = dict(zip((d for d, _ in corpus), library_ids([t for _, t in corpus]), strict=True))
    rows = q.op4_packing(spark, SF).collect()
    assert check_packing(rows, ids) > 0.95
    assert Counter(r.doc_id for r in rows) == {d: -(-len(x) // 2048) for d, x in ids.items()}


def test_differencing():
    rng = random.Random(5)
    for _ in range(60):
        sizes, k = [rng.randint(1, 100) for _ in range(rng.randint(0, 40))], rng.randint(1, 12)
        windows = difference(sizes, k)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and len(windows) == k
        if len(sizes) >= 5 * k:
            sums = [sum(sizes[i] for i in w) for w in windows]
            assert max(sums) - min(sums) <= max(sizes)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in difference([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_pack_keeps_items_whole():
    rng = random.Random(6)
    for _ in range(60):
        sizes = [rng.choice([0, 1, 7, 10, 25, rng.randint(0, 40)]) for _ in range(rng.randint(0, 30))]
        windows = pack(sizes, 10)
        pieces = sorted((i, s, n) for w in windows for i, s, n in w)
        flat = Counter((i, x) for i, s, n in pieces for x in range(s, s + n))
        assert flat == Counter((i, x) for i, n in enumerate(sizes) for x in range(n))
        assert all(0 < sum(n for *_, n in w) <= 10 for w in windows)
        assert Counter(i for i, *_ in pieces) == {i: -(-n // 10) for i, n in enumerate(sizes) if n}


def test_window_count_rises(monkeypatch):
    """As long as a window exceeds the capacity; a text of many windows is cut, and its rest packed like any item."""
    packing, tried = importlib.import_module("weftline.llm.packing"), []
    monkeypatch.setattr(packing, "difference", lambda sizes, k: tried.append(k) or difference(sizes, k))
    assert len(pack([7] * 10, 10)) == 10 and tried[0] == 7 and tried == sorted(set(tried)) and tried[-2] < 10 <= tried[-1]
    tried.clear()
    assert len(pack([5] * 10, 10)) == 5 and tried == [5]
    windows = pack([1_000_003, 4, 3], 10)
    assert len(windows) == 100_001 and sorted(windows[-1]) == [(0, 1_000_000, 3), (1, 0, 4), (2, 0, 3)]
    rng = random.Random(3)
    sizes = [min(2048, int(rng.expovariate(1 / 500)) + 1) for _ in range(500)]
    assert len(pack(sizes)) <= 1.03 * sum(sizes) / 2048


def test_packing_edges(spark):
    rows = pack_documents(odd_docs(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.length) for r in rows if r.doc_id is not None) == [(False, 1, 7), (False, 1, 7), (False, 2, 1), (False, 3, 1)] and len(rows) == 5
    assert pack_documents(odd_docs(spark).limit(0)).count() == 0


# --- 5: secrets -----------------------------------------------------------------------------------------------------------------


def brute_spans(text):
    """By regular expressions and a count of every window anew."""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    from weftline.llm.secret_scan import ALLOW

    base = sorted(found)
    for rank, cls in enumerate(CLASSES, 3):
        new = []
        for m in re.finditer(f"[{re.escape(cls.alphabet)}]{{{cls.least},}}", text):
            s = m[0]
            if not (re.search("[0-9]", s) and re.search("[A-Za-z]", s)) or re.search(ALLOW, s):
                continue
            over = [i for i in range(len(s) - cls.least + 1) if sum(cls.log_sums[c] for c in Counter(s[i : i + cls.least]).values()) <= cls.limit]
            if over:
                a, b = m.start() + over[0], m.start() + over[-1] + cls.least
                if not any(x[0] < b and a < x[3] for x in found):
                    new.append((a, rank, cls.kind, b))
        found += new
    return base, sorted(found)


def test_secret_scan(spark):
    rng = random.Random(7)
    pieces = ["token=", "secret: token=", "api_key", "APIKEY = '", "AKIA", "\n", " ", "é", "🙂", "xxxxxx", '"', "password", ":", "=", "deadbeef", "0123456789abcdef", "Passwd="]
    run = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-") for _ in range(rng.randint(3, 60)))
    low = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(3, 60)))
    texts = ["".join(rng.choice([rng.choice(pieces), rng.choice(pieces), run(), low()]) for _ in range(rng.randint(0, 14))) for _ in range(250)] + [None, "", "123e4567-e89b-12d3-a456-426614174000"]
    out = secret_scan(docs_of(spark, texts)).select("doc_id", spelled(F.col("base_spans")).alias("b"), spelled(F.col("spans")).alias("s")).collect()
    show = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    for r in out:
        base, every = brute_spans(texts[r.doc_id] or "")
        assert (r.b, r.s) == (show(base), show(every)), texts[r.doc_id]


def test_secret_scan_long(spark):
    """Twenty thousand secrets in a text, by brute force; the time is in proportion to the text."""
    rng = random.Random(31)
    pool = ["0123456789abcdef", "0123456789abcdefGHIJKLMNOPRSTUVX"]
    text = " ".join("".join(rng.choice(pool[i % 2]) for _ in range(26)) for i in range(20_000)) + " AKIA" + "Z9" * 9
    (r,) = secret_scan(docs_of(spark, [text])).collect()
    base = [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]{16,}", text)] + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]{24,}", text)]
    assert [tuple(s) for s in r.base_spans] == sorted(base)
    spans = [tuple(s) for s in r.spans]
    assert spans == sorted(spans) and len(spans) > 15_000 and set(base) <= set(spans)
    more = sorted(s for s in spans if s[1] > 2)
    assert more and all(a[3] <= b[0] for a, b in zip(spans, spans[1:]) if a[1] > 2 or b[1] > 2)


def test_secret_edges(spark):
    out = secret_scan(odd_docs(spark))
    assert out.columns == ["doc_id", "text", "n_lines", "hits", "__x", "base_spans", "spans"] and all(not r.spans for r in out.collect())
    assert secret_scan(odd_docs(spark).limit(0)).count() == 0


# --- 6: near copies -----------------------------------------------------------------------------------------------------------------


def brute_groups(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(root(i)))) for i, (d, _) in enumerate(rows))


def grouped(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_groups(df).collect())


def test_near_groups(spark, corpus):
    assert grouped(spark.read.parquet(f"{SF}/documents.parquet")) == brute_groups(corpus)


def test_near_groups_random(spark):
    """Mutations around the threshold, templates shared by many, copies, and a chain that links ends through its middle."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 400)}" for _ in range(60)]
    texts = []
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"m{rng.randint(0, 50)}"
        texts.append(" ".join(w))
    texts += [" ".join([f"u{i}_{j}" for j in range(rng.randint(0, 25))] + base[:40]) for i in range(60)]
    texts += [" ".join(base[: rng.randint(1, 12)]) for _ in range(40)] + texts[:10] + ["", None, " \t\n", "Ä ä", "ä ä", "A b", "a B"]
    chain = [f"c{i}" for i in range(120)]
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 40, 4)]
    rng.shuffle(texts)
    assert grouped(docs_of(spark, texts)) == brute_groups(list(enumerate(texts)))


def test_near_groups_split(spark):
    """Short texts that share a passage with long ones link although its postings are dealt to many parts."""
    rng = random.Random(12)
    texts = []
    for g in range(8):
        passage = [f"p{g}_{i}" for i in range(92)]
        texts += [" ".join([f"l{g}_{i}_{j}" for j in range(600)] + passage) for i in range(12)]
        texts += [" ".join([f"s{g}_{i}_{j}" for j in range(12)] + passage) for i in range(2)]
    rng.shuffle(texts)
    want = brute_groups(list(enumerate(texts)))
    assert len({c for *_, c in want}) == 8 * 13
    got = near_groups(docs_of(spark, texts), split=2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


def test_near_edges(spark):
    rows = [(r.doc_id, r.text) for r in odd_docs(spark).collect()]
    assert grouped(odd_docs(spark)) == brute_groups(rows)
    assert near_groups(odd_docs(spark).limit(0)).count() == 0
    kept = keep_one(docs_of(spark, ["a b c d e f", "a b c d e f", None, "", "z z"])).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2, 3, 4] and len(kept[0]) == 5
    assert sorted(str(r.doc_id) for r in keep_one(odd_docs(spark)).collect()) == ["1", "2", "3"]  # the row without id is a copy


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)


def test_keep_one_by_row(spark):
    """Repeated ids, rows that are equal, blank rows and groups without any id."""
    a, b, c, d = ("a b c d e f", "g h i j k l m", "n o p q r s", "t u v w x y z")
    kept = lambda rows: sorted((str(r.doc_id), str(r.text)) for r in keep_one(rows_of(spark, rows)).collect())
    assert kept([(0, a), (1, a), (1, b), (2, c)]) == [("0", a), ("1", b), ("2", c)]
    assert kept([(7, None), (7, None), (7, ""), (8, b), (8, b), (8, c)]) == [("7", ""), ("7", "None"), ("7", "None"), ("8", b), ("8", c)]
    assert kept([(None, d), (None, d), (None, a), (3, a)]) == [("3", a), ("None", d)]


def morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_near_groups_words_of_one_polynomial(spark):
    """Long words that any polynomial modulo a power of two takes for equal, and one very long word."""
    word = morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, f"x {word} y z u v", f"x {other} y z u v", "w" * 300_000, "w" * 299_999 + "v", "w" * 300_000]
    assert grouped(docs_of(spark, texts)) == brute_groups(list(enumerate(texts)))


def test_near_groups_hot(spark):
    """A shingle in all of 500 near copies, dealt to many parts, beside copies that are a little too far."""
    rng = random.Random(13)
    base = [f"h{i}" for i in range(80)]
    texts = []
    for i in range(500):
        w = list(base)
        for j in rng.sample(range(10, 80), rng.randint(0, 3)):
            w[j] = f"m{i}_{j}" if rng.random() < 0.7 else f"m{j}"
        texts.append(" ".join(w))
    want = brute_groups(list(enumerate(texts)))
    got = near_groups(docs_of(spark, texts), split=2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want and len({c for *_, c in want}) > 1


def test_near_groups_again_under_another_seed(spark, monkeypatch):
    """Different sets under one key are told by the second key."""
    join = importlib.import_module("weftline.llm.ngram_join")
    seeds = iter([5, 6])
    monkeypatch.setattr(join.secrets, "randbits", lambda n: next(seeds))
    job = join._profiled(docs_of(spark, ["a b c", "d e f"]), 5, 75, 100, 9, "text", "doc_id", None)
    assert job.terms.seed == 5 and job.classes.count() == 2
    one = job.classes.limit(1)
    assert one.select("k").first().k != 0
    fake = spark.createDataFrame([(1, 1, 2), (2, 3, 3)], "k long, o1 long, o2 long")
    real, calls = join.materialize, []

    def materialize(df, name):
        calls.append(name)
        return fake if name == "classes" and calls.count("classes") == 1 else real(df, name)

    seeds = iter([5, 6])
    monkeypatch.setattr(join, "materialize", materialize)
    assert join._profiled(docs_of(spark, ["a b c", "d e f"]), 5, 75, 100, 9, "text", "doc_id", None).terms.seed == 6


def test_shingle_kernel():
    texts = ["A b  c\td e f", "a b c d e f", "a b", "", " ", "x" * 5000 + " y", "é É"]
    sets = shingle_sets(texts)
    assert np.array_equal(sets[0], sets[1]) and [len(s) for s in sets] == [2, 2, 1, 0, 0, 1, 1]
    words, counts = word_hashes(texts)
    assert counts.tolist() == [6, 6, 2, 0, 0, 2, 2] and words[0] == words[6] and words[-1] != words[-2]
    rng = np.random.default_rng(2)
    for _ in range(50):
        pool = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = np.unique(rng.choice(pool, rng.integers(1, 200))), np.unique(rng.choice(pool, rng.integers(1, 200)))
        assert most_common(set_bits(a), set_bits(b), len(a), len(b)) >= len(np.intersect1d(a, b))


def test_prefix_choice():
    for n in range(1, 200):
        m, index, probe = choose_prefix(np.full(n, 50.0), n, 75, 100)
        assert 1 <= m <= math.ceil(0.75 * n) and index <= probe <= n
        assert index == min(n, n - math.ceil(6 * n / 7) + m) and probe == min(n, n - math.ceil(0.75 * n) + m)
    assert choose_prefix(np.zeros(100), 100, 75, 100)[0] == 1 and choose_prefix(np.full(100, 1e4), 100, 75, 100)[0] > 1


# --- 7: benchmark windows --------------------------------------------------------------------------------------------------------------


def test_windows_small(spark):
    items = spark.createDataFrame([(1, "One two three four five six seven eight nine ten eleven"), (2, "short item"), (2, "x"), (3, "..."), (4, None), (None, "only null id here"), (12, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    texts = ["zero one-two three; FOUR five six seven eight nine ten eleven twelve", "one two three four five six seven eight nine", "a SHORT item, x y", "", None, "only null id here", "short É item"]
    out = {r.doc_id: (r.n_words, list(r.hits), list(r["items"])) for r in find_windows(docs_of(spark, texts), items).collect()}
    assert out[0] == (13, list(range(1, 12)), ["1", "12"]) and out[1] == (9, [], []) and out[2] == (5, [1, 2, 3], ["2"])
    assert out[3] == (0, [], []) and out[4] == (0, [], []) and out[5] == (4, [0, 1, 2, 3], [""]) and out[6] == (3, [], [])
    assert sorted(r.doc_id for r in decontaminate(docs_of(spark, texts), items).collect()) == [1, 3, 4, 6]
    none = find_windows(odd_docs(spark), items.limit(0))
    assert none.columns == ["doc_id", "text", "spans", "n_lines", "__x", "n_words", "hits", "items"] and sorted(r.n_words for r in none.collect()) == [0, 0, 6, 6, 6]
    assert find_windows(odd_docs(spark).limit(0), items).count() == 0


def test_windows_long(spark, monkeypatch):
    """Repeated words, one very long text, and items taken in parts give what a plain look at every window gives."""
    monkeypatch.setattr(importlib.import_module("weftline.llm.decontaminate"), "PART", 7)
    rng = random.Random(21)
    words = lambda n, k: [f"v{rng.randint(0, k)}" for _ in range(n)]
    items = [words(60, 3), words(40, 500), ["a"] * 30, words(5, 2)]
    texts = [["a"] * 20_000, words(3000, 3), words(50, 500) + items[1][5:30] + words(9, 500), items[0] + items[0], items[3] * 4, ["a"] * 9]
    windows = defaultdict(set)
    for n, w in enumerate(items):
        size = min(10, len(w))
        for i in range(len(w) - size + 1):
            windows[tuple(w[i : i + size])].add(str(n))
    got = find_windows(docs_of(spark, [" ".join(t) for t in texts]), spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], "item_id long, text string"))
    for r in got.collect():
        t, hits, ids = texts[r.doc_id], set(), set()
        for size in (5, 10):
            for i in range(len(t) - size + 1):
                if named := windows.get(tuple(t[i : i + size])):
                    hits |= set(range(i, i + size))
                    ids |= named
        assert (r.n_words, list(r.hits), list(r["items"])) == (len(t), sorted(hits), sorted(ids))


# --- 8: exact copies -----------------------------------------------------------------------------------------------------------------------


def test_fingerprints_compose():
    rng = random.Random(9)
    for _ in range(20):
        data = rng.randbytes(rng.randint(0, 200_000))
        cut = rng.randint(0, len(data))
        assert combine(fingerprint(data[:cut]), fingerprint(data[cut:])) == fingerprint(data)
    assert fingerprint(b"\0a") != fingerprint(b"a") and fingerprint(b"ab") != fingerprint(b"ba")


def brute_copies(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        done = False
        for i in ids:
            kept = i == keep and not done
            done |= kept
            out.append((str(i), str(keep), len(ids), kept))
    return sorted(out)


def test_exact_dedup_edges(spark):
    rng = random.Random(10)
    texts = [rng.choice(["a", "b", "", None, "é" * 50, "xy" * 40]) for _ in range(60)]
    for huge, stream in ((1 << 20, 2), (16, 2)):
        out = exact_dedup(docs_of(spark, texts), huge=huge, stream=stream).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in out) == brute_copies(list(enumerate(texts)))
    rows = [(r.doc_id, r.text) for r in odd_docs(spark).collect()]
    out = exact_dedup(odd_docs(spark)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in out) == brute_copies(rows)
    assert exact_dedup(odd_docs(spark).limit(0)).count() == 0


# --- 9: licenses ----------------------------------------------------------------------------------------------------------------------------


def test_every_template_is_found():
    for name, text in TEMPLATES:
        found = findings(f"some words before\n{text}\nand after")
        assert [(x[0], x[1]) for x in found] == [(1, name)], text
        assert TEMPLATES[ranked(text)[0][1]][0] == name


def test_license_wording():
    assert findings("Licensed under CC BY-NC 3.0.") == [] and findings("no licence here") == []
    assert findings("Released under the  MIT\tLicense") [0][1] == "MIT"
    wrapped = TEMPLATES[4][1].replace(" may not ", "\nmay not ").replace("You may", "\nYou may")
    assert [x[1] for x in findings(wrapped)] == ["Apache-2.0"]
    assert differences(["a", "b", "c"], ["x", "a", "q", "c", "y"]) == (["b"], ["q"])


def test_license_every_notice():
    one = "Released under the MIT License. Licensed under CC BY 4.0."
    assert [x[:2] for x in findings(one)] == [(0, "MIT"), (0, "CC-BY-4.0")]
    assert [x[:2] for x in findings("Copyright (c) 2020 X\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.")] == [(1, "Apache-2.0"), (2, "MIT")]
    rng = random.Random(13)
    for _ in range(20):
        chosen = [rng.choice(TEMPLATES) for _ in range(rng.randint(1, 5))]
        text = " ".join(" ".join(rng.choices(["lorem", "ipsum", "dolor", "copyright"], k=rng.randint(3, 200))) + ". " + t for _, t in chosen)
        assert [x[1] for x in findings(text)] == [name for name, _ in chosen], text


def test_license_wrapped(spark):
    """A notice is found however its lines are broken, without a cue in its first line and over more lines than twelve."""
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed"
    assert [x[:2] for x in findings(mpl)] == [(0, "MPL-2.0")]
    for name, text in TEMPLATES:
        for width in (1, 2, 3, 7):
            w = text.split()
            wrapped = "\n".join("# " + " ".join(w[i : i + width]) for i in range(0, len(w), width))
            assert [x[:2] for x in findings(f"some words\nbefore\n{wrapped}\nand after")] == [(2, name)], wrapped
    (unlicense,) = [text for name, text in TEMPLATES if name == "Unlicense"]
    got = license_scan(docs_of(spark, [unlicense.replace("public domain", "public\n * domain")])).collect()
    assert [[x.license for x in r.findings] for r in got] == [["Unlicense"]]


def test_license_planted(spark):
    notices = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    for r in license_scan(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        assert [notices[x] for x in (r.text or "").split("\n") if x in notices] == [x.license for x in r.findings if x.license != "LicenseRef-all-rights-reserved"]
    odd = odd_docs(spark).withColumn("findings", F.lit(1))
    assert [list(r.findings) for r in license_scan(odd).collect()] == [[]] * 5 and license_scan(odd.limit(0)).count() == 0


# --- 10: language model -----------------------------------------------------------------------------------------------------------------------


def test_scores_by_brute_force(spark, monkeypatch):
    """From the counts of all words, with few words known to tasks and few members that are single words."""
    lm = importlib.import_module("weftline.llm.lm_score")
    monkeypatch.setattr(lm, "KNOWN", 4)
    texts = ["a b a c", "b", None, "", "zz a zz qz rare", "wz wz yz a", " ".join(["a", "b", "c", "zz"] * 5)]
    model = train(docs_of(spark, texts))
    net = Network.of(model.flat)
    assert 0 < len(model.lexicon.keys) <= 4 and model.counts.count() > 0
    scored = texts + ["never seen a", "a b a c", "x" * 200_000]
    counts = Counter(w for t in texts for w in (t or "").split())
    family = lambda w: int(word_keys([w])[0][0]) & 255
    known = {int(k): (int(m), int(n)) for k, m, n in zip(model.lexicon.keys, model.lexicon.members, model.lexicon.counts, strict=True)}
    single = {w for w in counts if known.get(int(word_keys([w])[0][0]), (9999,))[0] < lm.VOCABULARY - lm.FAMILIES}
    totals = Counter()
    for w, n in counts.items():
        if w not in single:
            totals[family(w)] += n
    for r in lm_score(docs_of(spark, scored), model).collect():
        words = (scored[r.doc_id] or "").split()
        member = [known[int(word_keys([w])[0][0])][0] if w in single else lm.VOCABULARY - lm.FAMILIES + family(w) for w in words]
        ids, total = np.array([0, 0, *member, 0, 0]), 0.0
        for i, w in enumerate(words):
            h = np.append(sum(net.embed[ids[i + 2 + d]].astype(float) * net.place[j] for j, d in enumerate((-2, -1, 1, 2))), 1.0)
            c, m = divmod(int(ids[i + 2]), 32)
            for logits, k in ((h @ net.cluster, c), (h @ net.member[c], m)):
                total += logits[k] - np.log(np.exp(logits).sum())
            if w not in single:
                total += np.log(counts.get(w, 1)) - np.log(totals[family(w)] + 1) * (1 if w in counts else 2)
        assert r.n_words == len(words) and abs(r.log_likelihood - total) < 1e-3 and (r.mean_log_likelihood is None) == (not words)


def test_model_prefers_real_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' AND n_chars > 400")
    model = train(docs)
    rng = random.Random(11)
    texts = [r.text for r in docs.limit(40).collect()]
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts]
    gibberish = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in w) for w in t.split()) for t in texts]
    score = lambda ts: [r.mean_log_likelihood for r in sorted(lm_score(docs_of(spark, ts), model).collect(), key=lambda r: r.doc_id)]
    real = score(texts)
    assert sum(a > b for a, b in zip(real, score(mixed), strict=True)) >= 28
    assert all(a > b for a, b in zip(real, score(gibberish), strict=True))
    again = train(docs.repartition(7))
    assert again.flat.tobytes() == model.flat.tobytes() and np.array_equal(again.lexicon.keys, model.lexicon.keys)


def test_equal_texts_score_alike(spark):
    """Bit for bit, in other batches and beside other texts; a document that the corpus has twice scores above chance."""
    rng = random.Random(17)
    texts = [" ".join(f"w{int(rng.expovariate(1 / 40))}" for _ in range(rng.randint(1, 80))) for _ in range(300)]
    docs = docs_of(spark, texts + texts[:50])
    model = train(docs)
    rows = {r.doc_id: r.log_likelihood for r in lm_score(docs, model).collect()}
    other = {r.doc_id: r.log_likelihood for r in lm_score(docs.repartition(9), model).collect()}
    assert rows == other and all(rows[i] == rows[300 + i] for i in range(50))


def test_every_position_is_trained(monkeypatch):
    lm = importlib.import_module("weftline.llm.lm_score")
    met = Counter()
    monkeypatch.setattr(Network, "learn", lambda self, ids, at, squares: met.update(ids[at].tolist()))
    blocks = [np.arange(a, b, dtype="<u2").tobytes() for a, b in ((2, 5), (5, 6), (6, 6), (6, 300), (300, 1000))]
    for step in (4, 4096):
        monkeypatch.setattr(lm, "STEP", step)
        met.clear()
        for turn in range(lm.ROUNDS):
            state = type("State", (), {"value": (Network.start().flat(), turn)})
            for cut in (1, 5):
                (out,) = lm._trained(state)(iter([pd.DataFrame({"bucket": [0, 0, 0, 1, 1][i : i + cut], "ids": blocks[i : i + cut]}) for i in range(0, 5, cut)]))
                assert len(out) == len(Network.start().flat()) + 1
        assert met == dict.fromkeys(range(2, 1000), 2)


def test_lm_edges(spark):
    model = train(odd_docs(spark).limit(0))
    assert lm_score(odd_docs(spark), model).count() == 5 and lm_score(odd_docs(spark).limit(0), model).count() == 0


# --- the pipeline --------------------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, corpus):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    seen = [docs]
    for _, stage in p.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], SF).cache())
        assert seen[-1].columns == docs.columns
    told, lined, single, clean = ({r.doc_id: r for r in x.collect()} for x in seen[1:])
    profiles = fit(docs.where(~is_held_out()))
    scores = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, profiles).collect()}
    assert set(told) == {d for d, (lang, s) in scores.items() if lang != UNDETERMINED and s >= p.MIN_SCORE}
    space = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(space))
    counts = Counter(k for r in told.values() for k in {key(x) for x in (r.text or "").split("\n")})
    assert {d: r.text for d, r in lined.items()} == {d: "\n".join(x for x in (r.text or "").split("\n") if not key(x) or counts[key(x)] < 10) for d, r in told.items()}
    assert all(r.n_chars == len(r.text) for r in lined.values())
    groups = brute_groups([(d, r.text) for d, r in lined.items()])
    assert {str(d) for d in single} == {d for d, _, c in groups if d == c}
    hits = {r.doc_id for r in find_windows(seen[3], spark.read.parquet(f"{SF}/benchmark.parquet")).where(F.size("hits") > 0).collect()}
    assert set(clean) == set(single) - hits
    ids = dict(zip(clean, library_ids([r.text for r in clean.values()]), strict=True))
    check_packing(p.run(spark, SF).collect(), ids)
