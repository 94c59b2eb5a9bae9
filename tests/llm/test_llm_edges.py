"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import os
import random
import sys
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from somnolyt.llm import bpe, catalog, chat, cnn, exact, langid, packing, rules, simhash, substring, toxicity

sys.path.insert(0, os.path.dirname(__file__))
import edge_rows as edge  # noqa: E402

WORD_FILE, BYTE_FILE, MULTI_FILE = (P.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def docs(spark):
    return edge.documents(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return edge.documents(spark, [])


def test_rules(docs, none):
    got = rules.quality_rules(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in edge.ROWS)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].n_words == 0 and by_id[1].base_failed and not by_id[1].kept
    assert by_id[4].n_words == 30_000 and by_id[4].n_repeat_words == 30_000 and by_id[4].base_failed
    assert rules.quality_rules(none).count() == 0


def test_chat(spark):
    said = [(1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 2, "assistant", "</s>[INST] ok <\\/s>"),
            (2, 0, "assistant", ""), (2, 1, "assistant", "x" * 100_000), (3, 0, "we[INST]ird", "[/INST]<s>[IMAGE]")]
    frame = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    shaped = frame.select("*", chat.text_part(F.col("text")).alias("parts"), F.lit("x").alias("formatted"), F.lit(1).alias("n"))
    formatted = chat.format_conversations(shaped)
    turns = formatted.select("conv_id", chat.parse_formatted(F.col("formatted")).alias("t"),
                             chat.loss_texts(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    got = {r.conv_id: [(t.role, t.text) for t in r.t] for r in turns}
    assert got == {1: [("", ""), ("user", "a"), ("user", "a")], None: [("assistant", "</s>[INST] ok <\\/s>")],
                   2: [("assistant", ""), ("assistant", "x" * 100_000)], 3: [("we[INST]ird", "[/INST]<s>[IMAGE]")]}
    assert {r.conv_id: r.loss for r in turns} == {1: [], None: ["</s>[INST] ok <\\/s>"], 2: ["", "x" * 100_000], 3: []}
    assert chat.format_conversations(shaped.limit(0)).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see [IMAGE]", None, None, None, None, None), ("image", None, "s3/a.png", 28, 29, None, None),
             ("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3),
             ("video", None, "d", None, None, None, None), (None, "t", None, None, None, None, None)]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)],
                                  f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.format_conversations(frame).first()
    assert row.formatted == ("<s>[INST]user[/INST]see [\\IMAGE][IMAGE][AUDIO][DOCUMENT][DOCUMENT]t</s>"
                             "[INST]assistant[/INST]</s>")
    assert [(a.message, a.part, a.kind, a.ref, a.tokens) for a in row.attachments] == [
        (0, 1, "image", "s3/a.png", 6), (0, 2, "audio", "b.wav", 50), (0, 3, "document", "c.pdf", 768), (0, 4, "document", "d", 1)]
    assert row.expanded_tokens == 825


def test_chat_is_reversible_over_parts(spark):
    """Control strings cut into parts at every place, in texts and roles, with attachments between."""
    r = random.Random(9)
    controls = ["<s>", "</s>", "[INST]", "[/INST]", "[IMAGE]", "[AUDIO]", "[DOCUMENT]", "<\\/s>", "[\\\\INST]", "<", "[", "\\"]
    text = lambda t: ("text", t, None, None, None, None, None)
    image = ("image", None, "a.png", 28, 28, None, None)
    rows = [(i, 0, "user", [text(c[:at]), text(c[at:])]) for i, (c, at) in enumerate((c, at) for c in controls for at in range(len(c) + 1))]
    for i in range(len(rows), len(rows) + 120):
        whole, parts = "".join(r.choices([*controls, "a", " "], k=6)), []
        while whole:
            cut = r.randrange(1, len(whole) + 1)
            parts += [text(whole[:cut])] + [image] * (r.random() < 0.2)
            whole = whole[cut:]
        rows.append((i, 0, "".join(r.choices(controls, k=2)), parts))
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {x.conv_id: x for x in chat.format_conversations(frame).select("*", chat.parse_formatted(F.col("formatted")).alias("t")).collect()}
    for i, _, role, parts in rows:
        assert [(t.role, t.text) for t in got[i].t] == [(role, "".join(p[1] if p[0] == "text" else "[IMAGE]" for p in parts))]
        assert got[i].formatted.count("[IMAGE]") == len(got[i].attachments) == sum(p[0] == "image" for p in parts)
        assert got[i].formatted.count("</s>") == got[i].formatted.count("[INST]") == 1


def test_exact(docs, none):
    got = exact.exact_dedup(docs).collect()
    want = {"": 4, "onetwothree": 4}
    assert len(got) == len(edge.ROWS)
    groups = Counter(r.text_sha256 for r in got)
    assert all(r.group_size == groups[r.text_sha256] for r in got)
    assert sum(r.kept for r in got) == len(groups)
    assert sorted(groups.values())[-2:] == sorted(want.values())
    assert {r.doc_id for r in got if r.kept and r.group_size > 1} == {3, 6}
    assert {r.keep_id for r in got if r.doc_id in (1, 2, 3)} == {3}
    assert exact.exact_dedup(none).count() == 0
    kept = exact.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_exact_falls_back_to_full_texts(docs):
    weak = exact.exact_dedup(docs, digest=lambda text: F.substring(text, 1, 1))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, weak.select(columns).collect())) == Counter(
        map(tuple, exact.exact_dedup(docs).select(columns).collect()))


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    fps = {(d, t): edge.fingerprint(t) for d, t in edge.ROWS}
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter(
        (d, f"{edge.fingerprint(t):016x}") for d, t in edge.ROWS)
    roots = edge.components([edge.fingerprint(t) for _, t in edge.ROWS])
    least = {}
    for (d, _), root in zip(edge.ROWS, roots):
        least[root] = min((x for x in (least.get(root), d) if x is not None), default=None)
    want = Counter((d, least[root]) for (d, _), root in zip(edge.ROWS, roots))
    assert Counter((r.doc_id, r.component_id) for r in got) == want and fps
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))


@pytest.mark.parametrize("crowded", [substring.CROWDED, 1])
def test_substring(docs, none, crowded):
    got = substring.substring_dedup(docs, crowded=crowded)
    assert sorted(f.name for f in got.schema["row"].dataType) == sorted(docs.columns)
    rows = got.select("row.doc_id", "row.text", "kept_text", "n_words", "n_removed").collect()
    kept = edge.without_repeats([t for _, t in edge.ROWS])
    want = Counter((d, t, " ".join(k), len(edge.words(t)), len(edge.words(t)) - len(k)) for (d, t), k in zip(edge.ROWS, kept))
    assert Counter(map(tuple, rows)) == want
    assert {r.doc_id for r in rows if r.n_removed} == {4, 7, 8}
    assert substring.substring_dedup(none, ["doc_id"]).count() == 0


def test_bpe(docs, none):
    encoded = bpe.encode_documents(docs, BYTE_FILE, P.PATTERN)
    decoded = bpe.decode_documents(encoded, BYTE_FILE, P.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in decoded) == Counter((d, (t or "").encode()) for d, t in edge.ROWS)
    assert bpe.round_trip_digests(docs, BYTE_FILE, P.PATTERN).count() == len(edge.ROWS)
    assert bpe.round_trip_digests(none, BYTE_FILE, P.PATTERN).count() == 0


def test_packing(spark, docs, none):
    single = [(i, t) for i, (_, t) in enumerate(edge.ROWS)]
    library = packing.word_tokenizer(WORD_FILE).library
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [1] for d, t in single}
    edge.pieces_are_whole(catalog.packed_pieces(edge.documents(spark, single), WORD_FILE).collect(), ids)
    total = catalog.packed_pieces(docs, WORD_FILE).agg(F.sum("length")).first()[0]
    assert total == sum(map(len, ids.values()))
    assert packing.pack(none, WORD_FILE).count() == 0


def test_learned_scores(docs, none):
    r = random.Random(3)
    filler = [[f"plain{r.randrange(400)}" for _ in range(40)] for _ in range(300)]
    sample = [(" ".join(w + ["idiot", "moron"] * (i % 5 == 0)), int(i % 5 == 0)) for i, w in enumerate(filler)]
    toxic = toxicity.train(sample)
    scored = toxicity.score_documents(docs, toxic).collect()
    assert len(scored) == len(edge.ROWS) and all(0 <= r.score <= 1 for r in scored)
    assert {r.doc_id for r in scored if r.score >= 0.5} == {12}
    assert {r.doc_id for r in scored if r.passages} == {12}
    assert toxicity.score_documents(none, toxic).count() == 0
    assert toxicity.drop_toxic(docs, toxic).count() == len(edge.ROWS) - 1
    net = cnn.train([("*** ### ***", 0), ("plain words go here", 1)] * 10)
    scored = cnn.score_documents(docs, net).collect()
    assert len(scored) == len(edge.ROWS) and all(0 <= r.score <= 1 for r in scored)
    assert cnn.score_documents(none, net).count() == 0


def test_language(spark, docs, none):
    texts = [(i, t, lang) for i, (t, lang) in enumerate([("the house is on the hill", "en"), ("das haus ist auf dem berg", "de")] * 20)]
    train = spark.createDataFrame(texts + [(99, None, "fr"), (98, "x", None)], "doc_id long, text string, lang string")
    learned = langid.learn(train, MULTI_FILE, 5, 0)
    assert set(learned) == {"de", "en"}
    got = langid.identify(docs, learned, MULTI_FILE).collect()
    assert len(got) == len(edge.ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id in (4, 5)} <= {"de", "en"}
    assert langid.identify(none, learned, MULTI_FILE).count() == 0
    assert langid.identify(docs, {}, MULTI_FILE).filter("lang_pred <> 'und'").count() == 0


def test_packing_reads_added_tokens_as_the_library_does(spark):
    library = Tokenizer.from_file(WORD_FILE)
    rows = list(enumerate(["one <|endoftext|> two", "a<|startoftext|>b<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext |>",
                           "é<|endoftext|>É 中<|endoftext|>文", "<|endoftext|>", "<|endoftext|", "x's<|endoftext|>'s 12<|startoftext|>34"]))
    ids = {d: library.encode(t, add_special_tokens=False).ids + [1] for d, t in rows}
    assert ids[0] == [637, 49407, 1237, 1]
    edge.pieces_are_whole(catalog.packed_pieces(spark.createDataFrame(rows, "doc_id long, text string"), WORD_FILE).collect(), ids)
