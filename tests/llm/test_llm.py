"""Results against plain Python over whole small tables, and odd inputs."""

import collections
import hashlib
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def rows(spark, folder, name):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]


@pytest.fixture(params=["tables", "edges"])
def folder(request, edge_dir):
    return SF if request.param == "tables" else edge_dir


def some(queries, prefix):
    return next(build for name, build in queries.items() if name.startswith(prefix))


def test_empty_tables(spark, queries, empty_dir):
    for name, build in queries.items():
        if re.match(r"op\d|pipeline", name):
            assert build(spark, empty_dir).count() == 0, name


def test_pipeline_on_odd_rows(spark, queries, edge_dir):
    found = queries["pipeline"](spark, edge_dir).collect()
    assert {r.doc_id for r in found} <= {2, 3, 4, 5, 6, 7}


def test_mix(spark, queries, folder):
    found = queries["op3_source_mix"](spark, folder).collect()
    docs = rows(spark, folder, "documents")
    size = {}
    for d in docs:
        size[d["source"]] = size.get(d["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(size), float(sum(size.values()))
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 3 * size[s]}
        if not over:
            target |= {s: unit * weight[s] for s in free}
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(3.0 * size[s] for s in over)
        free -= over
    source = {d["doc_id"]: d["source"] for d in docs}
    assert len(found) == len(docs)
    for r in found:
        assert r.source_size == size[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]], abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        assert r.size == 0 or r.taken // r.size - int(r.target / r.source_size + 1e-12) in (0, 1)


def test_decontamination(spark, queries, folder):
    found = queries["op5_benchmark_decontamination"](spark, folder).collect()
    windows = {}
    for item in rows(spark, folder, "benchmark"):
        w = words(item["text"])
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item["item_id"]))
    sizes = {len(w) for w in windows}
    want = []
    for doc in rows(spark, folder, "documents"):
        w, hit, items = words(doc["text"]), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    items |= got
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        want.append((doc["doc_id"] or -1, len(w), len(hit), len(items), sha, bool(hit) and 20 * len(hit) >= len(w)))
    assert sorted((r[0] or -1, *r[1:]) for r in found) == sorted(want)


def test_jaccard(spark, queries, folder):
    found = queries["op7_ngram_jaccard_join"](spark, folder).collect()
    docs = [(d["doc_id"], words(d["text"])) for d in rows(spark, folder, "documents")]
    sets = [({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()) for _, w in docs]
    n, links, top = len(docs), [0] * len(docs), list(range(len(docs)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                top[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    want = sorted((doc_id or -1, least.get(root(i)) or -1, links[i]) for i, (doc_id, _) in enumerate(docs))
    assert sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in found) == want


def test_jaccard_blocks_agree(spark, monkeypatch):
    from casewise.llm import jaccard

    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k:]]) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = sorted(map(tuple, jaccard.near_duplicates(docs).collect()))
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect())) == one
    assert {c for _, c, _ in one} == {0} and {n for *_, n in one} == {39}


def test_token_file(spark, queries, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = [(d["doc_id"], [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 1]) for d in rows(spark, folder, "documents")]
    docs.sort(key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    want, start = [], 0
    for doc_id, ids in docs:
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = queries["op8_rans_token_file"](spark, folder).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found), key=lambda r: r[1]) == want


def test_encoder_gives_the_ids_of_the_library():
    from tokenizers import Tokenizer

    from casewise.llm.rans import Encoder, tokenizer_facts, tokenizer_file

    tokenizer = Tokenizer.from_file(tokenizer_file(None))
    texts = ["Über-all, überall&&&; word### it's'S <|endoftext|>.", "", "  ", "<|startoftext|>a <|endoftext|>", "A\x1cB c\x85d", "İstanbul é.é", "ab." * 3, "12!? x²"]
    texts += [f"Wort{chr(c)}. {chr(c)}&&& ab{chr(c)}c" for c in range(0x3100) if not 0x1C <= c < 0x20]
    for split in (True, False):
        encoder = Encoder(tokenizer, "<u2", split and tokenizer_facts()[1], tokenizer_facts()[2])
        for some in (texts, texts[::-1], ["\x1d a.\x1e b", *texts]):  # known runs, and separators that stay for the library
            ids, n = encoder.encode(pa.array(["left out", *some], pa.string()).slice(1))
            assert np.split(ids, np.cumsum(n)[:-1])[0].tolist() == tokenizer.encode(some[0], add_special_tokens=False).ids
            want = [e.ids for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            assert ids.tolist() == [i for one in want for i in one] and n.tolist() == [*map(len, want)]
    # Words with marks of any kind behind them are looked up by their letters: a new mark brings no new word.
    assert set(encoder_words(["Haus", "haus&&&", "HAUS***", "haus."], tokenizer)) == {"haus"}


def encoder_words(texts, tokenizer):
    from casewise.llm.rans import Encoder, tokenizer_facts

    asked = []

    class Counted(Encoder):
        def words(self, words):
            asked.extend(words)
            return super().words(words)

    Counted(tokenizer, *tokenizer_facts()).encode(pa.array(texts))
    return asked


def test_a_known_word_in_any_case_and_marks_is_one_entry():
    """Runs are cut into words and marks before they are looked up, so that each word is kept and looked up once."""
    from tokenizers import Tokenizer

    from casewise.llm.rans import Encoder, tokenizer_facts, tokenizer_file

    tokenizer = Tokenizer.from_file(tokenizer_file(None))
    encoder = Encoder(tokenizer, *tokenizer_facts())
    texts = [word + marks for word in ("Straße", "straße", "STRAßE", "Haus", "haus") for marks in ("", ".", "!?", "***")]
    ids, n = encoder.encode(pa.array(texts))
    assert np.split(ids, np.cumsum(n)[:-1])[7].tolist() == tokenizer.encode(texts[7], add_special_tokens=False).ids
    assert set(encoder.store) == {"straße", "haus", "", ".", "!?", "***"}
    for none in ([], ["", " "]):
        ids, n = encoder.encode(pa.array(none, pa.string()))
        assert not len(ids) and n.tolist() == [0] * len(none)


def test_tokens_of_many_parts(spark, monkeypatch):
    from tokenizers import Tokenizer

    from casewise.llm import rans

    monkeypatch.setattr(rans, "CHARS", 40)
    monkeypatch.setattr(rans, "CACHE", 5)
    rows = [(i, None if i % 7 == 0 else "Some words, " * (i % 11) + f"w{i}***") for i in range(60)]
    found = rans.tokenized(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    tokenizer = Tokenizer.from_file(rans.tokenizer_file(None))
    want = {i: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1] for i, text in rows}
    assert {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in found} == want
    counts = {r.id: r.n for r in rans.token_counts(rans.tokenized(spark.createDataFrame(rows, "doc_id long, text string")), "<u2").collect()}
    assert counts == dict(collections.Counter(i for ids in want.values() for i in ids))


def test_no_tokenizer_outlives_its_task():
    """A tokenizer held by a cache of the module stays in the worker until Python happens to collect cycles."""
    from tokenizers import Tokenizer

    from casewise.llm import rans

    tokenizer = Tokenizer.from_file(rans.tokenizer_file(None))
    held = sys.getrefcount(tokenizer)
    rans.Encoder(tokenizer, *rans.tokenizer_facts()).encode(pa.array(["some words"]))
    assert sys.getrefcount(tokenizer) == held


def test_coder_round_trip_and_damage():
    from casewise.llm.rans import Coder, quantised

    draw = np.random.default_rng(1)
    for n in (1, 63, 64, 5000, 70_000):
        tokens = (draw.pareto(1.0, n) * 3).astype(np.int64) % 49_000
        ids, counts = np.unique(tokens, return_counts=True)
        coder = Coder(ids, quantised(counts))
        payload = coder.encode(tokens)
        assert (coder.decode(payload) == tokens).all()
        broken = bytearray(payload)
        broken[-1] ^= 1
        with pytest.raises(ValueError):
            coder.decode(bytes(broken))


def test_language(spark, queries, folder):
    found = {r.doc_id: r for r in queries["op9_language_id"](spark, folder).collect()}
    docs = rows(spark, folder, "documents")
    judged = right = 0
    for d in docs:
        r = found[d["doc_id"]]
        assert r.held_out == (None if d["doc_id"] is None else zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        letters = any(c.isalpha() for c in d["text"] or "")
        assert letters or r.lang_pred == "und"
        if r.held_out and letters and folder == SF:
            judged += 1
            right += r.lang_pred == d["lang"]
    assert right >= 0.9 * judged


def test_forward_sums_every_segmentation():
    from casewise.llm.language import word_scores

    pieces = {"▁": 0, "a": 1, "b": 2, "▁a": 3, "ab": 4, "▁ab": 5}
    probs = np.array([[0.1], [0.2], [0.3], [0.15], [0.05], [0.2], [1e-8], [0]])
    want = 0.1 * 0.2 * 0.3 + 0.15 * 0.3 + 0.1 * 0.05 + 0.2
    assert np.exp(word_scores(["▁ab"], pieces, probs, 3))[0, 0] == pytest.approx(want)


def secret_spans(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_secrets(spark, queries, folder):
    kinds = ("assign", "access", "hex")
    found = {r.doc_id: r for r in queries["op2_secret_scan"](spark, folder).collect()}
    for d in rows(spark, folder, "documents"):
        base, r = secret_spans(d["text"] or ""), found[d["doc_id"]]
        names = [f"{kinds[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert [s for s in r.spans.split(",") if s and not s.startswith("entropy")] == names


def test_window_entropy(spark):
    from pyspark.sql import functions as F

    from casewise.llm.secrets import window_entropy

    texts = ["aB3dE6gH9jK2mN5pQ8sT1vW4", "a" * 30, "ab1" * 10, "Zx9+/Qw3rT5yU7iOaaaaaaaaaaaaaaaaaaaaaa"]
    for text, got in spark.createDataFrame([(t,) for t in texts], "t string").select("t", window_entropy(F.col("t"))).collect():
        best = 0.0
        for i in range(len(text) - 19):
            _, n = np.unique(list(text[i : i + 20]), return_counts=True)
            best = max(best, -(n / 20 * np.log2(n / 20)).sum())
        assert got == pytest.approx(best)


def test_url_rules(spark, queries, folder):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    found = {r.page_id: r for r in queries["op4_url_rules"](spark, folder).collect()}
    pages = rows(spark, folder, "pages")
    assert len(found) == len(pages)
    for p in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", p["url"] or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [x for x in rules if ("." + host).endswith("." + x.split("/")[0]) and path.startswith("/" + x.split("/", 1)[1])]
        r = found[p["page_id"]]
        want = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, want)
        assert r.verdict == rules[want] if want else r.verdict in ("allow", "block")


def test_sketches(spark, queries, folder):
    from casewise.llm.sketch import ENDS

    def units(text):
        return {p for p in re.split(ENDS, text) if p.strip(" ")}

    def likeness(a, b):
        a, b = units(a), units(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    docs = {(d["doc_id"], d["text"]) for d in rows(spark, folder, "documents")}
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    found = {r.doc_id: r for r in queries["op10_document_sketch"](spark, folder).collect()}
    prints = {}
    for i, (doc_id, text) in enumerate(docs):
        text, nxt, r = text or "", docs[(i + 1) % len(docs)][1] or "", found[doc_id]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + nxt[:cut]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(likeness(text, edited)), doc_id
        assert r.near_next == pytest.approx(likeness(text, nxt)), doc_id
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint


def test_toxicity(spark, queries, folder):
    folder = folder.replace("sf0.001", "sf0.01")  # the smallest table has too few labels to learn from
    found = {r.doc_id: r for r in queries["op6_toxicity"](spark, folder).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in rows(spark, folder, "labels")}
    good = [r.score for i, r in found.items() if r.held_out and truth.get(i) == 0]
    bad = [r.score for i, r in found.items() if r.held_out and truth.get(i) == 1]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    if "sf0.01" in folder:
        assert np.mean([b > g for b in bad for g in good]) > 0.9


def test_toxic_sentence_is_found(spark):
    from casewise.llm import toxicity

    texts = [("the day was fine. you awful fool. rain came.", 1), ("the day was fine. rain came.", 0)] * 30
    docs = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], "doc_id long, text string, toxic int")
    got = toxicity.score(docs, toxicity.train(docs)).where("doc_id < 2").orderBy("doc_id").collect()
    assert [[(s.start, s.end) for s in r.offending] for r in got] == [[(17, 32)], []]


def test_chat(spark, queries, folder):
    from casewise.llm import chat

    found = queries["op1_chat_repair"](spark, folder).collect()
    by_conv = {}
    for r in sorted(found, key=lambda r: (r.part, r.seq)):
        by_conv.setdefault(r.conv_id, []).append(r)
    convs = {}
    for t in rows(spark, folder, "conversations"):
        convs.setdefault(t["conv_id"], []).append(t)
    assert by_conv.keys() == convs.keys()
    for conv, pieces in by_conv.items():
        text = "".join(p.rendered for p in pieces)
        roles = re.findall(r"<\|(system|user|assistant)\|>", text)
        assert roles[-1] == "assistant" and text.endswith("<|end|>\n")
        assert all(b in chat.LEGAL[a] for a, b in zip([None, *roles], roles))
        assert sum(p.action != "empty" for p in pieces) == len(convs[conv])


def test_chat_segments_agree_with_one_pass():
    from casewise.llm import chat

    draw = np.random.default_rng(3)
    for _ in range(200):
        roles = [("system", "user", "assistant", None)[i] for i in draw.integers(0, 4, draw.integers(1, 9))]
        cut = int(draw.integers(0, len(roles) + 1))
        parts = [p for p in (roles[:cut], roles[cut:]) if p]
        ends = chat.ends_of([chat.segment_costs(p) for p in parts])
        end = chat.segment_costs(roles)[0]
        want = min(end[s] + chat.ENDS[chat.STATES[s]][0] for s in range(4))
        cost, state = 0.0, 0
        for p, (a, b) in zip(parts, ends):
            for role, (_, _, to) in zip(p, chat.repair(p, a, b)):
                after = chat.STATES.index(to)
                cost, state = cost + chat.COSTS[role][state, after], after
        assert cost + chat.ENDS[chat.STATES[state]][0] == want


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_pipeline_filters_judge_rows_not_ids(spark, tmp_path):
    """Null ids are filtered like others, and rows that share an id are judged apart."""
    import corpus_pipeline

    def text(word):
        return " ".join(f"{word}{i}" for i in range(40))

    docs = [
        (None, text("a")), (None, text("a")), (None, text("a") + " more"), (7, text("b")), (None, text("b")),
        (1, text("c")), (1, text("d")), (1, text("d")), (None, text("e")), (2, text("d")), (None, text("bench")), (3, text("bench")), (3, text("f")),
    ]
    docs = spark.createDataFrame([(*d, "en", "s") for d in docs], "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert len(kept) == 7 and set(kept[0].asDict()) == {"doc_id", "text", "lang", "source"}
    assert sum(r.text.startswith("a0 ") and r.doc_id is None for r in kept) == 1
    rest = {(r.doc_id, r.text) for r in kept if not r.text.startswith("a0 ")}
    assert rest == {(7, text("b")), (1, text("c")), (1, text("d")), (None, text("e")), (3, text("bench")), (3, text("f"))}
    spark.createDataFrame([(1, text("bench"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()
    assert len(clean) == 11 and {(r.doc_id, r.text) for r in clean} == {(d.doc_id, d.text) for d in docs.collect() if "bench" not in d.text}


def entropy_spans(text):
    """Candidates that overlap no fixed span, are no plain words, numbers, UUIDs or samples, and reach their class's entropy."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        v = m[0]
        parts = [p for p in re.split(r"[/_=+-]+", v) if p]
        odd = [p for p in parts if not (p.isalpha() and (p.islower() or p.isupper() or (p[0].isupper() and p[1:].islower())))]
        named = [len(p) for p in odd if any(w in p.lower() for w in ("example", "sample", "placeholder"))]
        others = [len(p) for p in odd if not any(w in p.lower() for w in ("example", "sample", "placeholder"))]
        if any(a < m.end() and m.start() < b for a, _, b in secret_spans(text)) or not odd or all(p.isdigit() for p in parts):
            continue
        if re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", v) or max(others, default=0) < min(20, max(named, default=0)):
            continue
        need = 3.0 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", v) else 3.6 if v.isalnum() else 3.8
        best = 0.0
        for i in range(len(v) - 19):
            n = np.array([v[i : i + 20].count(c) for c in set(v[i : i + 20])])
            best = max(best, -(n / 20 * np.log2(n / 20)).sum())
        if best >= need - 1e-9:
            out.append(f"entropy:{m.start()}:{m.end()}")
    return out


def test_entropy_spans(spark, queries):
    from casewise.llm import secrets

    key, letters = "aB3dE6gH9jK2mN5pQ8sT1vW4xY7zR0cF2hL5", "qWeRtYuIoPaSdFgHjKlZxCvB"
    odd = {
        letters: 1, f"sample_key={key}": 1, f"/example/{key}": 1, f"{key}/example": 1, f"see placeholder-{letters} here": 1, f"Example1={key}": 1,
        "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY": 0, "some_plain-words/And/UPPER_case": 0, "abcdefghijklmnopqrstuvwxyz": 0,
        "12345678901234567890123": 0, "0123ABCD-0123-4567-89AB-0123456789AB": 0, "x" * 30 + "Y": 0, "ab-" * 20_000: 0,
    }
    texts = [*odd, *[d["text"] or "" for d in rows(spark, SF, "documents")]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.s for r in secrets.scan(docs).select("doc_id", secrets.joined("spans").alias("s")).collect()}
    got = [[s for s in found[i].split(",") if s.startswith("entropy")] for i in range(len(texts))]
    assert [len(g) for g in got[: len(odd)]] == list(odd.values())
    assert got == [entropy_spans(t) for t in texts]


def test_rare_languages_are_learned(spark):
    """A language's rows are all used while they are fewer than the sample, however many rows others have."""
    from casewise.llm import language

    draw = np.random.default_rng(2)
    words_of = {lang: [f"{lang}{''.join(draw.choice(list('abcdefgh'), 4))}" for _ in range(8)] for lang in ("q", "v", "x", "z", "k", "w")}
    docs = [(lang, " ".join(draw.choice(words_of[lang], 12))) for lang, n in zip(words_of, (4000, 6, 6, 6, 6, 6)) for _ in range(n)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string")
    model = language.train(docs, sample=100)
    assert model[0] == sorted(words_of)
    judged = language.detect(docs.where("lang <> 'q'"), *model).collect()
    assert len(judged) == 30 and all(r.lang_pred == r.lang for r in judged)


def test_stages_leave_clashing_columns_alone(spark, edge_dir):
    from pyspark.sql import functions as F

    import corpus_pipeline as p
    from casewise.llm.mixing import mixed_documents

    names = ["_source", "_size", "_copy", "_copies", "_row_key", "row", "_row", "_target", "_draw"]
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    docs = docs.withColumns({n: F.concat(F.lit(f"{n} "), F.coalesce("text", F.lit("none"))) for n in names})
    kept = p.benchmark_decontamination(spark, p.near_duplicates(spark, docs, edge_dir), edge_dir)
    for found in (mixed_documents(docs), kept):
        assert found.columns == docs.columns
        rows = found.collect()
        assert rows and all(r[n] == f"{n} {'none' if r['text'] is None else r['text']}" for r in rows for n in names)


def test_sketches_of_long_and_disjoint_texts(spark):
    from pyspark.sql import functions as F

    from casewise.llm import sketch

    def lines(tag, n):
        return "\n".join(f"{tag} line {i}" for i in range(n))

    pairs = [
        ("same", lines("a", 900), lines("a", 900)),
        ("one more", lines("a", 900), lines("a", 901)),
        ("all", lines("a", 700), lines("b", 2500)),
        ("half", lines("a", 300), lines("a", 150) + "\n" + lines("c", 40)),
        ("none", "", ""),
        ("from none", "", lines("d", 30)),
    ]
    df = spark.createDataFrame(pairs, "name string, x string, y string").select("name", *[sketch.digests(F.col(c)).alias(c) for c in "xy"])
    df = df.withColumns({f"{c}s": sketch.sketch(F.col(c)) for c in "xy"})
    df = df.withColumn("found", sketch.differences(F.col("x"), F.col("y"), sketch.subtract(F.col("xs"), F.col("ys"))))
    for r in df.select("name", "x", "y", "found", sketch.held(F.col("ys")).alias("n")).collect():
        assert sorted(r.found) == sorted(set(r.x) ^ set(r.y)), r.name
        assert r.n == len(r.y)


def test_successors_in_order_of_repeated_and_null_ids(spark):
    from casewise.llm import sketch

    values = [(None, f"null {i}") for i in range(40)] + [(7, f"seven {i}") for i in range(40)] + [(i, f"doc {i}") for i in range(0, 90, 3)]
    values += [(5, "again")] * 30
    docs = spark.createDataFrame(values, "doc_id long, _text string").selectExpr("doc_id", "xxhash64(doc_id, _text) AS _k", "_text")
    want = sorted({(r.doc_id, r._k, r._text) for r in docs.collect()}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    rows, repeated = sketch.with_next(docs)
    after = {w[1]: want[(i + 1) % len(want)][2] for i, w in enumerate(want)}
    assert {r._k: r._next for r in rows.collect()} == after and rows.count() == len(want)
    assert [r._times for r in repeated.collect()] == [30]
