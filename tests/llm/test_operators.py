"""Operators against brute force and exact round trips, with nulls, ties, empty and long texts, repeated rows and extra columns."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tarmac.llm import ann, chat_template, exact_dedup, minhash, packing, quality, sentencepiece_codec, sharding, suffix_dedup, toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
#: The extra columns bear names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, at long, bucket int, shard int, spans string, score double"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    base = words(rng, 120)
    texts = [words(rng, rng.randint(1, 90)) for _ in range(30)]
    texts += [base, base, base.replace(" ", "  "), base + " tail", "lead " + base, base.upper(), words(rng, 20) + " " + base[:400] + " " + words(rng, 20)]
    near = base.split()
    for k in range(4):
        near[10 + k * 3] = f"edit{k}"
        texts.append(" ".join(near))
    texts += [None, "", " \t\n", "one", "one two three four", "one two three four five", "é漢🎉 ▁x", "a" * 700, "ab " * 4000]
    rows = [(k, t, "en", "big" if k % 3 else f"s{k % 5}", None, 7, 1, 2, "x", 0.5) for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "null id text here now", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_exact_dedup(docs, empty):
    got = exact_dedup.deduplicate(docs).toPandas()
    groups: dict[str, list] = {}
    for i, t in rows_of(docs):
        groups.setdefault("".join(c for c in t if c not in " \t\n\x0b\x0c\r"), []).append((-len(t), i is None, i))
    expected = sorted((str(i), str(sorted(g)[0][2]), len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, _, i in g)
    name = lambda v: "None" if pd.isna(v) else str(int(v))
    assert sorted((name(r.doc_id), name(r.keep_id), r.group_size, r.text_sha256) for r in got.itertuples()) == expected
    kept = exact_dedup.keep(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.deduplicate(empty).count() == 0


def test_exact_dedup_keeps_state_between_arrivals(spark, docs):
    engine = exact_dedup.Deduplicator(spark, files_per_batch=1)
    engine.ingest(docs.where("doc_id < 30"))
    engine.ingest(docs.where("doc_id >= 30 or doc_id is null"))
    at_once = exact_dedup.Deduplicator(spark)
    at_once.ingest(docs)
    read = lambda e: sorted(map(str, e.groups().collect()))
    assert read(engine) == read(at_once)


def test_bytes_decide_when_digests_collide(spark):
    result = spark.createDataFrame([(1, 1, 3, "d", 11, 5), (2, 1, 3, "d", 12, 5), (3, 1, 3, "d", 13, 4)], "doc_id long, keep_id long, group_size long, text_sha256 string, locator long, n_chars long")
    other = spark.createDataFrame([("d", 2, 12, bytearray(b"x")), ("d", 3, 13, bytearray(b"x"))], "text_sha256 string, doc_id long, locator long, bytes binary")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup._apart(result, other).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (2, 2)}


def test_repeated_passages(docs, empty):
    got = suffix_dedup.RepeatedPassages(docs).result().toPandas()
    rows = rows_of(docs)
    cut = suffix_dedup.brute_force([t.encode() for _, t in rows])
    name = lambda v: "None" if pd.isna(v) else str(int(v))
    expected = sorted((name(i), len(t.encode()), sum(b - a for a, b in s), len(s), hashlib.sha256(suffix_dedup.without(t.encode(), s)).hexdigest()) for (i, t), s in zip(rows, cut))
    assert sorted((name(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()) == expected
    assert sum(e[2] for e in expected) > 3000
    shorter = suffix_dedup.RepeatedPassages(docs).keep()
    assert shorter.columns == docs.columns and shorter.count() == docs.count()
    assert suffix_dedup.RepeatedPassages(empty).result().count() == 0


def test_passages_of_random_overlaps(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcd") for _ in range(900))
    texts = [words(rng, rng.randint(0, 30)) + base[(a := rng.randrange(700)) : a + rng.choice([199, 200, 201, 260])] + words(rng, rng.randint(0, 30)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.RepeatedPassages(df).result().collect()}
    assert got == {k: (sum(b - a for a, b in s), len(s)) for k, s in enumerate(suffix_dedup.brute_force([t.encode() for t in texts]))}


def shingles(text: str) -> set:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, empty):
    got = minhash.near_duplicates(docs).toPandas()
    rows = rows_of(docs)
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = comp[a], comp[b]
                comp = [y if c == x else c for c in comp]
    low = {}
    for c, (i, _) in zip(comp, rows):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    name = lambda v: "None" if v is None or pd.isna(v) else str(int(v))
    expected = sorted((name(i), len(s), name(low.get(c))) for (i, _), s, c in zip(rows, sets, comp))
    assert sorted((name(r.doc_id), r.n_shingles, name(r.component_id)) for r in got.itertuples()) == expected
    kept = minhash.keep(docs)
    assert kept.columns == docs.columns
    assert minhash.near_duplicates(empty).count() == 0


def test_long_texts_have_the_same_shingles_in_blocks():
    text = words(random.Random(1), 3000).encode()
    whole = next(iter(minhash.shingle_sets([text])))
    old, minhash.BLOCK = minhash.BLOCK, 997
    try:
        assert np.array_equal(whole, next(iter(minhash.shingle_sets([text]))))
    finally:
        minhash.BLOCK = old


def test_components_of_a_chain(spark):
    from tarmac.plans.work import Workspace

    ids = list(range(20))
    labels = spark.createDataFrame([(i, i) for i in ids], "cid long, comp long")
    links = spark.createDataFrame([(ids[k + 1], ids[k]) for k in range(15)], "a long, b long")
    got = {r.cid: r.comp for r in minhash.merge(Workspace(spark, "t"), labels, links).collect()}
    assert got == {i: ids[0] if k <= 15 else i for k, i in enumerate(ids)}


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    got = packing.pack(docs, WORD_BPE, 256).toPandas()
    library = Tokenizer.from_file(WORD_BPE)
    pieces = []
    for i, t in rows_of(docs):
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[at : at + 256], dtype="<u4")
            pieces.append((str(i), p, at, len(part), zlib.crc32(part.tobytes())))
    name = lambda v: "None" if pd.isna(v) else str(int(v))
    assert sorted((name(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == sorted(pieces)
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert (seq["offset"].to_numpy() == np.concatenate(([0], np.cumsum(seq["length"])[:-1]))).all() and seq["length"].sum() <= 256
    assert got["sequence_id"].nunique() <= 1.1 * -(-got["length"].sum() // 256) + 1
    assert packing.pack(empty, WORD_BPE).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_each_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(129, dtype=np.int64)
    counts[rng.integers(1, 129, 40)] = rng.integers(1, 300, 40)
    plan = packing.Plan(counts, 128)
    assert (plan.used == counts).all()
    used: dict[int, list] = {}
    for length, runs in plan.runs.items():
        ends = [r[0] for r in runs[1:]] + [int(counts[length])]
        for (first, sequence, offset), end in zip(runs, ends):
            for k in range(end - first):
                used.setdefault(sequence + k, []).append((offset, length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 128
    assert sorted(used) == list(range(plan.sequences))


def optimum(lengths: list[int], capacity: int) -> int:
    """The least number of sequences, by trying every place."""
    best = [len(lengths)]

    def place(k: int, rooms: list[int]) -> None:
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for r in {room: n for n, room in enumerate(rooms) if room >= lengths[k]}.values():
            rooms[r] -= lengths[k]
            place(k + 1, rooms)
            rooms[r] += lengths[k]
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best[0]


def test_plans_of_small_histograms_against_the_optimum():
    rng = random.Random(3)
    over = 0
    for _ in range(40):
        lengths = sorted((rng.randint(1, 24) for _ in range(rng.randint(1, 12))), reverse=True)
        plan, best = packing.Plan(np.bincount(lengths, minlength=25), 24), optimum(lengths, 24)
        assert best <= plan.sequences <= best + 1
        over += plan.sequences - best
    assert over <= 6


def test_least_squares_are_not_negative_and_exact_where_they_can_be():
    found = [(5, 3), (4, 4), (5, 2, 1), (3, 3, 2), (6, 1, 1)]
    made = np.array([7.0, 0.0, 4.0, 0.0, 9.0])
    counts = sum(n * np.bincount(p, minlength=7) for n, p in zip(made, found))
    assert np.allclose(packing.fit(counts, found), made, atol=1e-6)
    rng = np.random.default_rng(5)
    for _ in range(20):
        counts = rng.integers(0, 50, 7)
        x = packing.fit(counts, found)
        a = np.stack([np.bincount(p, minlength=7) for p in found], 1)
        gain = a.T @ (counts - a @ x)
        assert (x >= 0).all() and (gain <= 1e-5 * max(1, counts.max())).all() and (np.abs(gain[x > 0]) <= 1e-4 * max(1, counts.max())).all()


def test_patterns_carry_most_sequences():
    rng = np.random.default_rng(7)
    lengths = np.minimum(np.exp(rng.normal(6.3, 1.2, 20_000)).astype(int) + 1, 4096)
    counts = np.bincount(lengths, minlength=4097)
    plan = packing.Plan(counts, 4096)
    assert plan.fitted >= 0.6 * (plan.sequences - plan.full)
    assert plan.sequences <= 1.002 * -(-int((counts * np.arange(4097)).sum()) // 4096) + 1


def test_merge_table_gives_what_the_vocabulary_gives():
    assert packing.Merges(WORD_BPE).check()


def test_word_tokens_equal_the_library():
    rng = random.Random(5)
    parts = [" ", "a", "The", "É", "\n", "\t", "\x00", "é", "漢", "🎉", "́", "<|endoftext|>", "İ", "ß", "Σ", "'s", "1", "23", ".", "\x1c", "\x85", "　", "\xa0", "don't", "...", "K", "!!", "\x7f", "ÿß", "»", "…", "’s", "'ll", "ÀÖ", "<|", "µ", "×"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(4000)]
    t = packing.WordTokenizer(WORD_BPE)
    for text, ids in zip(texts, t.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.library.encode(text, add_special_tokens=False).ids


def test_sentencepiece_equals_the_library(docs):
    codec = sentencepiece_codec.Codec(PIECE_BPE)
    rng = random.Random(6)
    parts = [" ", "  ", "a", "the", "▁", "\n", "\x00", "é", "漢", "🎉", "́", "</s>", "<0x0A>", "ﬁ", "　", "▁▁", "�"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(4000)]

    def library(text):
        ids = codec.library.encode(text, add_eos=True)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.library.decode(ids).encode()).hexdigest()

    assert list(codec.summaries(texts)) == [library(t) for t in texts]
    assert all(codec.encode(t) == codec.library.encode(t, add_eos=True) for t in texts[:500])
    got = sentencepiece_codec.encode(docs, PIECE_BPE).toPandas()
    name = lambda v: "None" if pd.isna(v) else str(int(v))
    assert sorted((name(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.itertuples()) == sorted((str(i), *library(t)) for i, t in rows_of(docs))


@pytest.mark.parametrize("shards", [1, 5, 16, 200])
def test_sharding(docs, shards):
    got = sharding.interleave(docs, shards).toPandas()
    rows = rows_of(docs)
    n = len(rows)
    assert len(got) == n and sorted(got["size"]) == sorted(len(t.encode()) + 1 for _, t in rows)
    assert sorted(got["text_crc32"]) == sorted(zlib.crc32(t.encode()) for _, t in rows)
    sizes = got.groupby("shard").size().reindex(range(shards), fill_value=0)
    assert sizes.max() - sizes.min() <= 1 and set(got["law"]) == {"rows"}
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_shards_match_the_mixture(spark):
    rows = [(k, f"t{k}", "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = sharding.interleave(df, 8).join(df.select("doc_id", "source"), "doc_id").toPandas()
    per = got.groupby(["shard", "source"]).size().unstack(fill_value=0)
    share = per.sum() / 8
    assert ((per - share).abs() <= 2).all().all()
    again = sharding.interleave(df.repartition(2), 8).toPandas()
    assert sorted(map(tuple, got[["doc_id", "shard", "slot"]].to_numpy())) == sorted(map(tuple, again[["doc_id", "shard", "slot"]].to_numpy()))


def test_no_shards_of_nothing(empty):
    assert sharding.interleave(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.interleave(empty, 0)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(0, 1, (1500, 8)) + rng.integers(0, 6, (1500, 1)) * 3
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    rows += [(2000 + k, vectors[0].tolist()) for k in range(40)] + [(3000, None), (3100, [0.0] * 8), (3200, [float("nan")] * 8), (3300, [1.0] * 7 + [None]), (3400, [1.0] * 3), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got, truth = ann.nearest(df).toPandas(), ann.exact(df.where(F.size("embedding") == 8), 100, 10)
    assert ann.recall(got, truth) >= 0.9
    assert got.groupby("query_id").size().eq(10).all() and set(got["query_id"]) == set(truth["query_id"])
    same = got[got["query_id"] == 0].sort_values("rank")
    assert same["vec_id"].tolist() == list(range(2000, 2010)) and same["score"].eq(0).all()
    few = df.where("vec_id in (0, 5, 7)").dropDuplicates(["vec_id"])
    assert ann.nearest(few).count() == 2
    assert ann.nearest(df.limit(0)).count() == 0


def fold(i) -> bool:
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality(spark, empty):
    rng = random.Random(1)
    good = [words(rng, rng.randint(20, 80)) for _ in range(150)]
    bad = [" ".join(f"{w}!!" for w in words(rng, rng.randint(20, 80)).upper().split()) for _ in range(60)]
    bad += [" ".join(w for x in words(rng, 15).split() for w in [x] * 5) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(good + bad)]
    df = spark.createDataFrame([*rows, (9001, None), (9002, ""), (None, "text"), (9003, "word " * 40000)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k < 150), 0) for k, _ in rows] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    net = quality.train(df, labels)
    got = quality.score(df, net).toPandas()
    assert len(got) == len(rows) + 4 and got["score"].between(0, 1).all()
    held = got[got["held_out"] & (got["doc_id"] < 270)]
    assert ((held["predicted"] == 1) == (held["doc_id"] < 150)).mean() > 0.9
    assert all(r.held_out == fold(int(r.doc_id)) for r in got.itertuples() if not pd.isna(r.doc_id))
    kept = quality.score(df, net, keep=True)
    assert kept.columns == df.columns and kept.count() == (got["score"] >= 0.3).sum()
    assert quality.score(empty, quality.train(empty, labels.limit(0))).count() == 0


def test_scores_do_not_depend_on_blocks():
    net, text = quality.Network(1), words(random.Random(2), 4000).encode()
    whole = net.probability(text)
    old, quality.BLOCK = quality.BLOCK, 1024
    try:
        assert abs(net.probability(text) - whole) < 1e-5
    finally:
        quality.BLOCK = old


def test_toxicity(spark, empty):
    rng = random.Random(1)
    insults = ["idiot", "moron", "worthless", "pathetic"]
    rows = []
    for k in range(600):
        w = words(rng, rng.randint(20, 120)).split()
        if k % 2:
            for _ in range(max(1, len(w) // 40)):
                w.insert(rng.randrange(len(w)), rng.choice(insults))
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame([*rows, (9001, None), (9002, "..."), (None, "text")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, 1, k % 2) for k, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels)
    got = toxicity.score(df, model).toPandas()
    held = got[got["held_out"] & (got["doc_id"] < 600)]
    assert len(got) == 603 and ((held["predicted"] == 1) == (held["doc_id"] % 2 == 1)).mean() > 0.9
    unseen = list(model.score(["what an idioot you are you see here now", "a quiet text of no such words here now"]))
    assert unseen[0] > unseen[1]
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0))).count() == 0


def test_template_language():
    t = chat_template.Template("{% set a = 'x' ~ 1 %}{% for m in ms %}{{ loop.index }}{% if loop.last and not false %}!{% elif m == 'b' %}{{ m | upper }}{% else %}-{% endif %}{{ a }}{% endfor %}")
    assert t.render(ms=["a", "b", "c"])[0] == "1-x12Bx13!x1"
    assert chat_template.parse("{{ 'a' ~ 'b' }}c") and chat_template.Template("{{ 'a' ~ 'b' | upper }}c{% if 1 == 2 %}d{% endif %}").tree == [chat_template.Text("aBc")]
    text, spans = chat_template.Template("a{% generation %}{{ x }}{% endgeneration %}b").render(x="é🎉")
    assert text == "aé🎉b" and spans == [(1, 3)]
    for bad in ("{% for x in y %}", "{{ f() }}", "{{ x | nothing }}", "{% import os %}", "{% endif %}", "{{ 1 2 }}", "{{ 'a' + 1 }}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.Template(bad)
    with pytest.raises(chat_template.TemplateError):
        chat_template.Template("{{ x.__class__ }}").render(x="s")


@pytest.mark.parametrize(("source", "text"), [
    ("a {%- if true -%} b {%- endif %} c", "ab c"),
    ("{# a note with {{ x }} #}x", "x"),
    ("{{ '}}' ~ \"%}\" }}", "}}%}"),
    ("{% for m in ms if m.role != 'system' %}{{ loop.index }}{{ m.role[:1] | upper }}{% endfor %}", "1U2A"),
    ("{{ ms[1:] | length }}{{ ms[-1]['role'] }}{{ ms[0:1][0].role }}", "2assistantsystem"),
    ("{{ 'b' in names and 'z' not in names }}{{ missing is defined }}{{ ms is not none }}", "TrueFalseTrue"),
    ("{{ names | join(', ') }}|{{ missing | default('none') }}|{{ 7 - 2 * 3 }}|{{ -7 // 2 }}|{{ 7 % 4 }}", "a, b|none|1|-4|3"),
    ("{{ 'x' if ms | length > 2 else 'y' }}{{ ' a '.strip() }}{{ names[0].upper() }}{{ 'ab'.startswith('a') }}", "xaATrue"),
    ("{% set n = [1, 2, names[1]] %}{{ n | join('-') }}", "1-2-b"),
])
def test_more_of_the_template_language(source, text):
    names = {"ms": [{"role": r, "text": r} for r in ("system", "user", "assistant")], "names": ["a", "b"]}
    assert chat_template.Template(source).render(**names)[0] == text


def test_a_template_as_published_ones_are():
    source = """{%- if messages[0]['role'] == 'system' -%}
        {%- set first = messages[0]['content'].strip() + '\\n\\n' -%}{%- set rest = messages[1:] -%}
    {%- else -%}{%- set first = '' -%}{%- set rest = messages -%}{%- endif -%}
    {%- for message in rest -%}
        {%- if (message['role'] == 'user') != (loop.index0 % 2 == 0) -%}{{ raise_exception('roles must alternate') }}{%- endif -%}
        {%- if message['role'] == 'user' -%}{{ '[Q] ' + (first if loop.first else '') + message['content'] | trim + ' [/Q]' }}
        {%- else -%}{%- generation -%}{{ ' ' ~ message['content'] | trim ~ ' ' }}{%- endgeneration -%}{{ end }}{%- endif -%}
    {%- endfor -%}"""
    said = [{"role": "system", "content": " be brief "}, {"role": "user", "content": "a "}, {"role": "assistant", "content": "b"}, {"role": "user", "content": "c"}]
    text, spans = chat_template.Template(source).render(messages=said, end="</s>")
    assert text == "[Q] be brief\n\na [/Q] b </s>[Q] c [/Q]" and [text[a:b] for a, b in spans] == [" b "]
    with pytest.raises(chat_template.TemplateError, match="alternate"):
        chat_template.Template(source).render(messages=said[2:], end="")


@pytest.mark.parametrize("source", ["{{ 3 | length }}", "{{ 'a' * 9 }}", "{{ x.format(1) }}", "{{ x.strip }}", "{{ 1 is nothing }}", "{{ 'a' - 1 }}", "{{ 1 // 0 }}", "{{ 'open", "{% if true %}", "{{ [1, 2 }}", "{{ x['__class__'] }}"])
def test_what_the_language_refuses(source):
    with pytest.raises(chat_template.TemplateError):
        chat_template.Template(source).render(x="text")


def test_escapes_round_trip():
    rng = random.Random(4)
    for _ in range(5000):
        text = "".join(rng.choices(["\\", "#", "##", "###", "</turn>", "<", "h", "t", "b", ":", "\n", " ", "### User: "], k=rng.randint(0, 9)))
        assert chat_template.unescape(chat_template.escape(text)) == text
        assert "###" not in chat_template.escape(text) and "</turn>" not in chat_template.escape(text)


def test_chats(spark):
    rows = [(1, 1, "assistant", "</turn>\n### User: x"), (1, 0, "user", None), (2, 0, None, "a"), (2, 0, None, "a"), (2, 1, "od:d ### ", ""), (None, None, "assistant", "\\h"), (3, 0, "assistant", "long " * 50000)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("turns", F.lit(1)).repartition(2)
    got = {None if pd.isna(r.conv_id) else int(r.conv_id): r for r in chat_template.read_back(chat_template.format_chats(df)).toPandas().itertuples()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\n</turn>\n### User: x\n") and got[1].loss_sha256 == sha("</turn>\n### User: x")
    assert got[2].turns_sha256 == sha("\na\n\na\nod:d ### \n\n") and got[2].n_turns == 3 and got[2].loss_chars == 0
    assert got[None].loss_sha256 == sha("\\h") and got[3].loss_chars == 250000
    assert chat_template.read_back(chat_template.format_chats(df.limit(0))).count() == 0
