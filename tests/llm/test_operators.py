"""Each operator against SQL, the library or brute force, and on odd inputs."""

import hashlib
import random
import textwrap
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftgraph.llm import chat, decontaminate, licenses, line_dedup, mixing, near_dup, quality, queries, token_count, token_records, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["a", "aaaa", "Z", "é", "é", "'s", "'", "1", "²", ".", ",", " ", "\n", "  ", "\t", "　", "<|endoftext|>", "<|STARTOFTEXT|>", "<|", "Σ", "İ,", "中", "\U0001f600", "_", "\x1c", "\x85", "́", "the", "!!!", "\xa0", "banana"]


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, same, name):
    same(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name])


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_token_counts_are_the_librarys():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = odd_texts(3000, 1)
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_count.Vocabulary(path).count_batch(texts) == want


def test_token_counts_of_long_runs_and_texts(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    v, lib, rng = token_count.Vocabulary(path), Tokenizer.from_file(path), random.Random(7)
    runs = ["".join(rng.choice(s) for _ in range(n)) for s in ("acgt", "abcdefghijklmnopqrstuvwxyz", "a", "é中ß", "=-", " \n") for n in (257, 1000, 5001)]
    texts = [*runs, *[f"{a} word {b}" for a, b in zip(runs, runs[1:], strict=False)]]
    want = [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert v.count_texts(texts) == want
    monkeypatch.setattr(token_count, "PIECE", 7)
    odd = [t * 5 for t in odd_texts(800, 9)]
    assert v.count_texts(odd) == [len(lib.encode(t, add_special_tokens=False).ids) for t in odd]
    monkeypatch.undo()
    run = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20))
    start = time.perf_counter()
    n = v.count_texts([run])[0]
    took = time.perf_counter() - start
    assert n == len(lib.encode(run, add_special_tokens=False).ids) and took < 10


def test_token_counts_of_all_documents_are_the_librarys(spark, sf):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: (len(t.encode()), n := len(lib.encode(t, add_special_tokens=False).ids), n > 512) for i, t in docs.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op2_token_counts(spark, sf).collect()} == want


def test_token_counts_with_a_small_cache(monkeypatch):
    monkeypatch.setattr(token_count, "CACHE_PIECES", 5)
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["one two three four five six seven eight", "nine ten one two", "", "eleven\n\ntwelve"]
    v = token_count.Vocabulary(path)
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert v.count_batch(texts) == want and v.count_batch(texts[::-1]) == want[::-1]


def test_token_counts_of_odd_rows(spark):
    df = docs(spark, (1, None, "a"), (1, "", "a"), (None, "word " * 600, "a"))
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(df, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got == {(1, 0, 0, False), (None, 3000, 601, True)}


def test_word_encoder_is_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), token_records.WordEncoder(path)
    for t in odd_texts(3000, 2):
        assert list(np.frombuffer(own.encode(t), own.kind)) == lib.encode(t, add_special_tokens=False).ids, repr(t)
    tiny = token_records.WordEncoder(path, 3)
    t = "one two three four five six one two"
    assert list(np.frombuffer(tiny.encode(t), tiny.kind)) == lib.encode(t, add_special_tokens=False).ids


def test_token_records(spark, sf):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-1, "twice"), (-1, "twice")], "doc_id long, text string"))
    got = [tuple(r) for r in token_records.read_token_records(token_records.write_token_records(df, path), per_task=7).orderBy("start").collect()]
    want, start = [], 0
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.text is not None, (r.text or "").encode())):
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_records.read_token_records(token_records.write_token_records(df.limit(0), path)).count() == 0


def test_records_notice_damage():
    data = bytearray(token_records.framed(b"hello"))
    assert token_records.unframed(bytes(data)) == (b"hello", len(data))
    data[14] ^= 1
    with pytest.raises(ValueError):
        token_records.unframed(bytes(data))


def test_line_dedup_of_odd_rows(spark):
    df = docs(spark, (2, "A common line\nown line two\n a COMMON line ", "x"), (1, "a common line\n\nshort", "x"), (3, None, "x"), (4, "short\nshort", "x"), (5, "twice the same\ntwice the same", "x"), (None, "a common line", "x"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {2: ("own line two", 3, 2), 1: ("a common line\n\nshort", 3, 0), 3: ("", 1, 0), 4: ("short\nshort", 2, 0), 5: ("twice the same\ntwice the same", 2, 0), None: ("", 1, 1)}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_a_full_filter_and_small_buckets_change_nothing(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(tuple(r) for r in line_dedup.dedup_lines(df).collect())
    monkeypatch.setattr(line_dedup, "BITS_PER_LINE", 0.01)
    assert sorted(tuple(r) for r in line_dedup.dedup_lines(df).collect()) == want
    monkeypatch.undo()
    monkeypatch.setattr(line_dedup, "BUCKET_LINES", 8)
    monkeypatch.setattr(line_dedup, "WINDOW", 50)
    assert sorted(tuple(r) for r in line_dedup.dedup_lines(df).collect()) == want


@pytest.mark.parametrize("n", [2000, 20000])
def test_the_share_of_wrong_suspects_does_not_grow(n):
    rng = np.random.default_rng(1)
    once = rng.integers(0, 1 << 63, (n, 2), np.uint64)
    twice = rng.integers(0, 1 << 63, (n // 10, 2), np.uint64)
    every = np.concatenate([once, twice, twice]).view(line_dedup.DIGEST)[:, 0]
    every = every[rng.permutation(len(every))]
    buckets, chunks, found = max(64, 1 << (len(every) // 64).bit_length()), {}, []
    for lo in range(0, len(every), 500):
        some = every[lo : lo + 500]
        for i, a, b, m in line_dedup.window_rows(some, np.arange(lo, lo + len(some)), buckets):
            if i < 0:
                found += np.frombuffer(a, line_dedup.DIGEST)["a"].tolist()
            else:
                chunks.setdefault(i, []).append((np.frombuffer(a, line_dedup.DIGEST), np.frombuffer(b, np.int64), np.frombuffer(m, line_dedup.DIGEST)))
    for c in chunks.values():
        found += [x for d, _ in line_dedup.suspects(c) for x in d["a"].tolist()]
    repeats = set(twice[:, 0].tolist())
    assert repeats <= set(found) and len([x for x in found if x not in repeats]) < 0.02 * n
    assert sorted(x for x in found if x in repeats) == sorted([*repeats, *repeats])


def test_warc_splits_and_odd_rows(spark):
    long = "<p>" + "x" * 300
    rows = [(3, "http://c/\r\n", long), (1, None, long), (2, "http://b/", None), (None, "u", long), (4, "http://d/", "é" * 60), (4, "http://d/", "é" * 60), (5, "", "short"), (6, "", "short")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_warc(df)
    for split in (50, 333, 1 << 20):
        got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(manifest, split=split).collect()), key=str)
        want = [(1, 303, "response", None), (2, 0, "response", None), (3, 303, "revisit", 1), (4, 120, "response", None), (4, 120, "response", None), (5, 5, "response", None), (6, 5, "response", None), (None, 303, "response", None)]
        assert got == sorted(want, key=str)
    assert warc.read_warc(warc.write_warc(df.limit(0))).count() == 0


def test_warc_with_damage_reads_the_same_for_every_split(spark, tmp_path):
    parts = [warc.member(i, f"http://h/{i}", f"<p>{'page ' * i * 20}</p>".encode(), hashlib.sha256(f"<p>{'page ' * i * 20}</p>".encode()).hexdigest(), None) for i in range(10)]
    starts = [sum(map(len, parts[:i])) for i in range(11)]
    bad = bytearray(parts[4])
    bad[len(bad) // 2] ^= 0xFF
    lost = warc.member(7, None, b"other than its digest says", "0" * 64, None)
    data = b"".join([*parts[:4], bytes(bad), *parts[5:7], lost, *parts[8:]])
    (tmp_path / "a.warc.gz").write_bytes(data)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", len(data), 10)], "path string, n_bytes long, n_records long")
    for split in (40, starts[3], starts[4], starts[5], 1 << 20):
        records = warc.read_warc(manifest, split=split)
        assert sorted(r.page_id for r in records.collect()) == [0, 1, 2, 3, 5, 6, 8, 9]
        assert warc.skipped_bytes(manifest, records).first().skipped == len(bad) + len(lost)


def test_ranges_are_not_read_by_one_task(spark):
    rows = [(i, "u", f"page {i} " * 100) for i in range(300)]
    manifest = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"))
    records = warc.read_warc(manifest, split=100)
    assert records.rdd.getNumPartitions() > 100 and records.count() == 300
    shards = token_records.write_token_records(spark.createDataFrame([(i, "a few words") for i in range(300)], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"))
    ids = token_records.read_token_records(shards, per_task=2)
    assert ids.rdd.getNumPartitions() > 100 and ids.count() == 300


def test_chat_templates():
    run = chat.compiled("{# c #}{% for m in messages %}{% if loop.first and m.role != 'x' %}<{{ 'a' + 'b' | upper }}>{% endif %}{% generation %}{{ m.text | trim }}{% endgeneration %}{% endfor %}!")
    assert list(run([{"role": "u", "text": " hi "}, {"role": "u", "text": "yo"}])) == [("<aB>", False), ("hi", True), ("yo", True), ("!", False)]
    assert chat.folded(chat.parse("{% if 1 == 1 %}a{{ 'b' }}{% else %}c{% endif %}d")) == (chat.Text("abd"),)
    for bad in ("{{ m.__class__ }}", "{% for x in y %}{% endfor %}", "{{ a | eval }}", "{% if a %}", "{{ open('f') }}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.compiled(bad)


def test_chat_escapes_are_undone():
    for t in [*odd_texts(500, 5), "<|end|>", "\\<|", "\\\\|<\\|", "<\\|", "\\"]:
        assert "<|" not in chat.escape(t) and chat.unescape(chat.escape(t)) == t


def test_chat_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 10)
    rows = [(1, 2, "assistant", "b<|end|>\\"), (1, 1, "user", None), (1, 2, "assistant", "a"), (None, 0, None, "x"), (2, 0, "assistant", "")]
    out = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert out == {1: (3, 10), None: (1, 0), 2: (1, 0)}


def test_quality_of_odd_rows(spark):
    window = "one two three four five six seven eight "
    df = docs(spark, (1, None, "a"), (2, "", "a"), (3, window * 3, "a"), (4, "the of and to " * 5 + " ".join(f"w{i}x" for i in range(40)), "a"))
    got = {r.doc_id: (r.n_words, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(df).collect()}
    assert got[1] == got[2] == (0, 0, True) and got[3] == (24, 24, True) and got[4][0] == 60
    assert quality.keep_good(df).columns == df.columns


def jaccard_components(rows):
    sets = {i: set(near_dup.shingle_hashes(t).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_of_chains_hubs_and_odd_rows(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, i = [], 0
    base = [word() for _ in range(80)]
    for _ in range(60):  # a chain: each a little further from the first
        rows.append((i, " ".join(base)))
        base[rng.randrange(80)] = word()
        i += 1
    shared = [word() for _ in range(50)]
    for _ in range(60):  # a shared passage, texts of their own
        rows.append((i, " ".join([*shared, *[word() for _ in range(40)]])))
        i += 1
    rows += [(i + k, t) for k, t in enumerate([None, "", "  \n", "one two", "ONE two", "one two three", rows[0][1], rows[0][1].upper()])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()}
    assert got == jaccard_components(rows)
    assert near_dup.near_duplicates(df.limit(0)).count() == 0
    assert near_dup.keep_representatives(df).count() == len({c for _, c in got.values()})


def test_decontamination_against_brute_force(spark, sf):
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = set()
    items = [(i, *[decontaminate.shingles_of(decontaminate.words_of(p)) for p in decontaminate.parts_of(t)]) for i, t in b.collect()]
    for r in d.collect():
        words = decontaminate.words_of(r.text)
        for i, q, a in items:
            inside = decontaminate.shingles_of_window(words, (q, a))
            if len(q & inside) >= 0.75 * len(q) and len(a & inside) >= 0.75 * len(a):
                want.add((r.doc_id, i))
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()} == want and want
    assert decontaminate.keep_clean(d, b).count() == d.count() - len({x for x, _ in want})


def test_decontamination_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 2)
    b = spark.createDataFrame([(i, t) for i, t in enumerate(["What is the seventh colour of a rainbow seen at noon? It is violet.", None, "", "Name the longest river that crosses five countries here. The long one.", "one two"])], "item_id long, text string")
    d = docs(spark, (1, "x " * 50 + "what IS the seventh colour of a rainbow, seen at noon? It is violet. " + "y " * 50, "s"), (2, None, "s"), (3, "", "s"), (4, "clean text", "s"), (5, "say one two three", "s"))
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()} == {(1, 0), (5, 4)}
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0 and decontaminate.keep_clean(d.limit(0), b).count() == 0


def test_decontamination_of_an_edited_or_missing_last_sentence(spark, sf):
    rows, near = spark.read.parquet(f"{sf}/benchmark.parquet").collect(), []
    for i, t in rows:
        q, a = decontaminate.parts_of(t)
        w = a.split()
        for n, copy in enumerate([q, q + " ".join(w[: len(w) // 2] + ["otherwise"] + w[len(w) // 2 + 1 :])]):
            whole = decontaminate.shingles_of(decontaminate.words_of(t))
            if a and len(whole & decontaminate.shingles_of(decontaminate.words_of(copy))) >= 0.75 * len(whole):
                near.append((2 * i + n, "before it " * 70 + copy + " after it" * 70, "s"))
    assert {x % 2 for x, _, _ in near} == {0, 1} and len(near) > 20
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs(spark, *near), spark.createDataFrame(rows, "item_id long, text string")).collect()}
    assert {(x, x // 2) for x, _, _ in near} <= set(got)
    assert all(r.item_share >= 0.75 or min(r.question_share, r.answer_share) >= 0.75 for r in got.values())
    b = spark.createDataFrame([(1, "Which of the four rivers named above runs through the most countries on its way to the sea?", "The second one")], "item_id long, question string, answer string")
    d = docs(spark, (1, "Which of the four rivers named above runs through the most countries on its way to the sea? The third one", "s"), (2, "Which of the four rivers named above is the longest? The second one", "s"))
    assert [r.doc_id for r in decontaminate.contaminated(d, b, question="question", answer="answer").collect()] == [1]


@pytest.mark.parametrize("named", [False, True])
def test_decontamination_scores_do_not_depend_on_shards(spark, sf, monkeypatch, named):
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    d = b.selectExpr("item_id as doc_id", "concat(repeat('before it ', 40), regexp_replace(text, '^[^ ]+ ', 'changed '), repeat(' after it', 40)) as text")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "...")], b.schema)
    columns = {"question": "text", "answer": "extra"} if named else {}
    items = b.unionByName(more).selectExpr("item_id", "text", "'It is the last one.' as extra")
    d = d.selectExpr("doc_id", "concat(text, ' It is the last one.') as text")
    want = sorted(map(tuple, decontaminate.contaminated(d, items, **columns).collect()))
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 13)
    got = sorted(map(tuple, decontaminate.contaminated(d, items, **columns).collect()))
    assert len(want) >= b.count() and got == want


def test_decontamination_of_many_and_long_items(spark):
    """One pass over 10,000 items; an item of thousands of words is found and doesn't blur the short ones."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [" ".join(word() for _ in range(rng.randint(6, 80))) for _ in range(10_000)] + [" ".join(word() for _ in range(5000))]
    rows = [(i, t, "") for i, t in enumerate(texts)]
    index = decontaminate.Index.of(rows)
    assert len(index.items) == len(rows) <= decontaminate.SHARD_ITEMS and len(index.classes) > 2
    shingles = [decontaminate.shingles_of(decontaminate.words_of(t)) for t in texts]
    for n in range(12):
        picked = rng.sample(range(10_000), 3) + [10_000] * (n == 0)
        parts = []
        for i in picked:
            w = texts[i].split()
            w[rng.randrange(len(w))] = "changed"
            parts += [" ".join(word() for _ in range(150)), " ".join(w)]
        text = " ".join(parts)
        inside = decontaminate.shingles_of(decontaminate.words_of(text))
        want = {i for i, s in enumerate(shingles) if len(s & inside) >= 0.75 * len(s)}
        assert set(index.found_in(text, 0.6, 0.75)) == want


def test_mixing_weights_and_odd_rows(spark):
    rows = [(i, "w " * 10, "big") for i in range(400)] + [(1000 + i, "w " * 10, "small") for i in range(20)] + [(5000, None, None), (5001, "a b", None)]
    df = docs(spark, *rows)
    out = mixing.mix_sources(df, entropy_share=0.9, max_repeats=3.0).collect()
    per = {}
    for r in out:
        per.setdefault(r.source, []).append(r)
    assert len(out) and set(map(len, [out[0]])) == {7}
    assert len(per["small"]) <= 3 * 20 + 1 and len(per["small"]) > 20 and len(per["big"]) < 400
    assert {r.doc_id for r in per["small"] if r.mix_block == 0} == set(range(1000, 1020))
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_mixing_of_sources_without_tokens(spark):
    some = [(i, "one two three", "a" if i % 2 else "b") for i in range(20)]
    none = [(100, None, "null"), (101, "", "empty"), (102, " \n\t", "white"), (103, None, "white")]
    mixed = lambda rows: sorted((r.source, r.doc_id, r.mix_block, r.mix_key) for r in mixing.mix_sources(docs(spark, *rows)).collect())
    assert mixed(some + none) == mixed(some) and mixed(some)
    assert mixed(none) == []


def test_licences(spark):
    text = "intro\n  LICENSED under the Apache License, version 2.0!\nReleased under the MIT License.\nReleased under the MIT License."
    df = docs(spark, (1, text, "a"), (2, None, "a"), (3, "", "a"), (4, licenses.TEMPLATES["MIT-text"].replace("Permission", "permission"), "a"))
    got = {(r.doc_id, r.unit, r.license) for r in licenses.scan_licenses(df).collect()}
    assert got == {(1, 2, "Apache-2.0"), (1, 3, "MIT"), (1, 4, "MIT"), (4, 1, "MIT-text")}


def best_dice(words, grams):
    """The largest Dice of any run of words, by trying all."""
    best = 0.0
    for a in range(len(words) - 1):
        own, both = set(), 0
        for b in range(a + 1, min(len(words), a + 2 * len(grams) + 2)):
            g = f"{words[b - 1]} {words[b]}"
            both += g in grams and g not in own
            own.add(g)
            best = max(best, 2 * both / (len(own) + len(grams)))
    return best


def test_notices_inside_longer_documents(spark):
    rng, texts = random.Random(3), licenses.TEMPLATES | licenses.FULL_TEXTS
    other = lambda n: " ".join(f"other{i % 37} words" for i in range(n // 2))
    rows, where = [], {}
    for n, (k, t) in enumerate(texts.items()):
        wrapped = textwrap.wrap(t, 72)
        rows.append((n, other(100) + "\n" + "\n".join(wrapped) + "\n" + other(100), "s"))
        where[n] = (k, 2, 1 + len(wrapped))
        rows.append((100 + n, f"Copyright 2020 A Holder. {t} {other(100)}\n{t}", "s"))
    names = ("MIT-text", "GPL-3.0-header", "BSD-2-Clause-full", "Apache-2.0")
    for n in range(60):
        w = texts[names[n % 4]].split()
        for _ in range(rng.randint(0, len(w) // 8)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [w[i], "and"], ["changed"]])
        rows.append((1000 + n, other(20) + " ".join(w) + " " + other(20), "s"))
    rows += [(2000, None, "s"), (2001, "", "s"), (2002, "under the", "s"), (2003, other(3000), "s")]
    got = {}
    for r in licenses.find_notices(docs(spark, *rows)).collect():
        got.setdefault((r.doc_id, r.license), []).append((r.first_line, r.last_line, r.dice))
    for n, (k, first, last) in where.items():
        assert got[n, k] == [(first, last, 1.0)]
        assert got[100 + n, k] == [(1, 1, 1.0), (2, 2, 1.0)]
    judged = {True: 0, False: 0}
    for n, t, _ in rows[-64:-4]:
        for k in names:
            best = best_dice(licenses.words_of(t), set(licenses.bigrams_of(texts[k])))
            judged[best >= 0.8] += 1
            assert ((n, k) in got) == (best >= 0.8), (n, k, best)
            assert (n, k) not in got or abs(max(x[2] for x in got[n, k]) - best) < 0.02
    assert min(judged.values()) > 10 and not any(d >= 2000 for d, _ in got)
