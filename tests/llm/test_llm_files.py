"""Vocabularies, pages, conversations and the pipeline."""

import random
import re

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from kgspark.llm import pieces, site_style, snapshots, token_store

BPE = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = public_tokenizers.path(pieces.VOCABULARY)
TEXTS = st.text(st.sampled_from("abthe .,\n  \t▁éß日#😀'sN1²٣"), max_size=40)


# ------------------------------------------------------------------- pieces

@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_pieces_round_trip(text):
    encoder = pieces.pieces_of(VOCABULARY)
    assert encoder.decode(encoder.encode(text)[0]) == text


@settings(max_examples=60, deadline=None)
@given(st.text("the aniou\n", min_size=1, max_size=14))
def test_pieces_take_the_best_path(text):
    """The score equals that of a plain search over all cuts."""
    encoder = pieces.pieces_of(VOCABULARY)
    marked = (" " + text).replace(" ", pieces.MARK)
    best = [0.0] + [float("-inf")] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - 16), end):
            part = marked[start:end]
            if encoder.automaton.exists(part):
                best[end] = max(best[end], best[start] + encoder.automaton.get(part)[2])
        if marked[end - 1] not in encoder.single:
            best[end] = max(best[end], best[end - 1] + encoder.unknown)
    assert encoder.encode(text)[1] == pytest.approx(best[-1])


def test_pieces_of_whole_documents(spark):
    """Counts equal the library's over whole texts, the best path equals a search over all
    pieces at all positions, and there are no more ids than the library gives."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id <= 40").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    scores = np.frombuffer(pieces.piece_scores(docs, VOCABULARY), "<f8")
    assert np.exp(scores).sum() == pytest.approx(1)
    counts = {r["piece"]: r["n"] for r in pieces.piece_counts(docs, VOCABULARY).collect()}
    words = [w for t in texts.values() for w in re.split("[ \n]", t)]
    assert sum(counts.values()) == sum(len(model.encode(w)) for w in words) + sum(t.count("\n") for t in texts.values())
    known = {}
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            known[model.id_to_piece(i)] = scores[i]
    longest, unknown = max(map(len, known)), min(known.values()) - pieces.UNKNOWN_PENALTY

    def best_score(text):
        marked = (" " + text).replace(" ", pieces.MARK)
        best = [0.0] + [float("-inf")] * len(marked)
        for end in range(1, len(marked) + 1):
            for start in range(max(0, end - longest), end):
                piece = known.get(marked[start:end])
                if piece is not None:
                    best[end] = max(best[end], best[start] + piece)
            if marked[end - 1] not in known:
                best[end] = max(best[end], best[end - 1] + unknown)
        return best[-1]

    got = pieces.encode(docs, VOCABULARY).collect()
    assert len(got) == len(texts)
    for row in got:
        assert row["round_trip"]
        if texts[row["doc_id"]] and pieces.MARK not in texts[row["doc_id"]]:
            assert row["score"] == pytest.approx(best_score(texts[row["doc_id"]]))
    assert sum(r["n_tokens"] for r in got) <= sum(len(model.encode(t)) for t in texts.values())


def test_pieces_of_a_table(spark):
    rows = [(1, "The thing. The end"), (2, None), (3, ""), (None, "▁x ▁"), (5, "z" * 70000 + " y"), (1, "The thing. The end")]
    docs = spark.createDataFrame([(i, t, [1], 2) for i, t in rows], "doc_id bigint, text string, ids array<int>, n_tokens int")
    encoded = pieces.encode(docs, VOCABULARY)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in encoded.collect())
    back = [(r["doc_id"], r["text"]) for r in pieces.decode(encoded, VOCABULARY).collect()]
    assert sorted(map(str, back)) == sorted(str((i, t or "")) for i, t in rows)
    assert pieces.encode_digests(docs, VOCABULARY).where("round_trip").count() == len(rows)
    assert pieces.encode(docs.limit(0), VOCABULARY).count() == 0


# -------------------------------------------------------------- token store

@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_have_the_ids_they_have_in_the_text(text):
    encoder = token_store.encoder(BPE, 2)
    assert np.frombuffer(encoder.encode(text), "<u2").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 1 << 60), max_size=300))
def test_perfect_hash(keys):
    hashes = token_store._hashes([str(k).encode() for k in keys])
    perfect = token_store.PerfectHash.build(hashes)
    assert sorted(perfect.slots(hashes).tolist()) == list(range(len(keys)))


def test_token_store(spark, scratch):
    rng = random.Random(3)
    rows = [(i * 3 - 40, " ".join(rng.choice(["the", "Thing,", "é", "x\n\ny", "", "  "]) for _ in range(rng.randint(0, 40)))) for i in range(90)]
    rows += [(5000, None), (5001, "long " * 30000), (7, "<|endoftext|> a<|endoftext|>")]
    docs = spark.createDataFrame([(i, t, 9, 9) for i, t in rows], "doc_id bigint, text string, start int, shard int")
    folder = scratch.new_path("store")
    manifest = token_store.write_store(docs, BPE, folder)
    want = brute.token_rows([(i, t or "") for i, t in rows], Tokenizer.from_file(BPE))
    got = token_store.read_digests(spark, folder)
    assert sorted(tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
    assert manifest.count() > 1
    found = token_store.look_up(spark, folder, rows[20][0])
    assert [f.tolist() for f in found] == [Tokenizer.from_file(BPE).encode(rows[20][1]).ids + [2]]
    assert token_store.look_up(spark, folder, 123456) == []


def test_token_store_of_awkward_rows(spark, scratch):
    docs = spark.createDataFrame([(4, "b"), (4, "a"), (4, "a"), (None, "c"), (None, None)], "doc_id bigint, text string")
    folder = scratch.new_path("store")
    token_store.write_store(docs, BPE, folder)
    rows = token_store.read_store(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, 4, 4, 4] and all(r["ids"][-1] == 2 for r in rows)
    assert sorted(len(x) for x in token_store.look_up(spark, folder, 4)) == [2, 2, 2]
    assert len(token_store.look_up(spark, folder, None)) == 2
    empty = scratch.new_path("store")
    token_store.write_store(docs.limit(0), BPE, empty)
    assert token_store.read_digests(spark, empty).count() == 0


# -------------------------------------------------------------------- pages

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head>
<body><header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p><b>First  {0}<br>line</b>
<p>Second &lt;x&gt; &eacute;</p><div class="ad">Buy</div><ul><li>one<li>two</ul><form><input value="q">Send</form></article>
<aside>Side</aside><div id="comments"><p>Nice!</p></div><footer>&copy; {0}</footer>"""


def test_main_text():
    assert site_style.main_text(PAGE.format(1)) == "Title & more\nFirst 1 line\nSecond <x> é\none\ntwo"
    assert site_style.main_text("") == "" and site_style.main_text("plain &am") == "plain &am"
    assert site_style.main_text("<p>a<p>b <i>c</i>d<script>x") == "a\nb cd"
    assert site_style.main_text("<div>" * 5000 + "deep") == "deep"


@pytest.mark.parametrize("wrapper", [
    "<div class='content has-sidebar'>", "<div class='layout-with-nav'>", "<div class='no-comments'>", "<div id='search-results'>",
    "<main><div class='content has-sidebar'>", "<main><div id='search-results'>", "<div class='pageHasSidebar'>",
])
def test_class_words_around_an_article(wrapper):
    page = wrapper + "<p>Out</p><article><h1>Title</h1><p>Much of the text</p><div class=ad>Buy</div></article></div>"
    assert site_style.main_text(page).endswith("Title\nMuch of the text")
    for name in ("comments", "related-posts", "sidebar"):
        aside = f"<article>Main text</article><div class={name}><article>{'An entry, long ' * 9}</article></div>"
        assert site_style.main_text(aside) == "Main text"
    assert site_style.main_text("<div class=share-buttons>x</div><article>y<div class=share>z</div></article>") == "y"
    assert site_style.main_text("<p>Post of its own</p><div id=search><p>Find</p></div>") == "Post of its own"


def test_site_style_trees(spark, scratch):
    """A block all pages of a host share goes, though nothing in its markup says so."""
    rows = [(i, f"https://Site.example/{i}", f"<body><div class=k1>Same words</div><div class=k2>Own words {i}</div>") for i in range(12)]
    rows += [(50, "https://small.example/", "<body><div class=k1>Same words</div>"), (51, None, None), (52, "x", "")]
    rows += [(60 + i, "https://copies.example/", "<article><h1>Same</h1><p>Text</p></article>") for i in range(20)]
    rows += [(90 + i, f"https://near.example/{i}", f"<article><h1>Same</h1><p>Text</p><p>{i}</p></article>") for i in range(20)]
    pages = spark.createDataFrame([(*r, "c", "c") for r in rows], "page_id bigint, url string, html string, low string, path string")
    got = {r["page_id"]: r for r in site_style.extract(pages, scratch).collect()}
    assert all(got[i]["text"] == f"Own words {i}" for i in range(12))
    assert got[50]["text"] == "Same words" and got[51]["text"] == got[52]["text"] == "" and got[51]["n_chars"] == 0
    assert got[65]["text"] == "Same\nText" and got[95]["text"] == "Same\nText\n5"
    assert site_style.extract(pages.limit(0), scratch).count() == 0


def test_site_style_judges_groups_of_articles(spark, scratch):
    """Plain groups alike on nearly all pages of a host go; those of some pages, and paragraphs, stay."""
    page = "<article><h1>Title {0}</h1><p>Same</p><div><p>Notice</p></div><section>Own {0}</section><ul><li>Follow us</ul>{1}</article>"
    rows = [(i, "https://a.example/x", page.format(i, "<div>Passage</div>" if i % 4 else "")) for i in range(40)]
    rows += [(100 + i, "https://few.example/x", page.format(i, "")) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_style.extract(pages, scratch).collect()}
    assert all(got[i] == f"Title {i}\nSame\nOwn {i}" + "\nPassage" * (i % 4 > 0) for i in range(40))
    assert got[100] == "Title 0\nSame\nNotice\nOwn 0\nFollow us"


# ------------------------------------------------------------ conversations

def test_snapshots(spark, scratch):
    rng = random.Random(2)
    talks, rows = {}, []
    for c in range(40):
        turns = [("user" if k % 2 == 0 else "assistant", "t%d" % rng.randrange(2)) for k in range(rng.randint(1, 7))]
        talks[c] = tuple(turns)
        rows += [(c, k, r, t) for k, (r, t) in enumerate(turns)] * rng.randint(1, 2)
    talks[100] = tuple(("user", "t%d" % k) for k in range(600))
    rows += [(100, k, r, t) for k, (r, t) in enumerate(talks[100])] + [(101, k, r, t) for k, (r, t) in enumerate(talks[100][:300])]
    rows += [(None, 0, "user", "x"), (200, None, None, None), (201, 0, "user", "")]
    table = spark.createDataFrame([(*r, 1, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, place int, h1 int")
    got = {}
    for r in snapshots.collapse_and_render(table, scratch, part_turns=50).orderBy("conv_id", "part").collect():
        got.setdefault(r["conv_id"], []).append((r["n_turns"], r["copies"], r["text"]))
    want = {}
    for c, t in talks.items():
        if not any(len(o) > len(t) and o[:len(t)] == t for o in talks.values()):
            same = [d for d, o in talks.items() if o == t]
            want[min(same)] = (len(t), len(same), "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in t))
    want[200], want[201] = (1, 1, "<|user|>\n<|end|>\n"), (1, 1, "<|user|>\n<|end|>\n")
    assert {c: (p[0][0], p[0][1], "".join(x[2] for x in p)) for c, p in got.items()} == want
    assert len(got[100]) == 12
    assert snapshots.collapse_and_render(table.limit(0), scratch).count() == 0


# ----------------------------------------------------------------- pipeline

def test_pipeline(spark, tmp_path):
    """Each stage against its restatement, on what the stage before kept."""
    rng = random.Random(9)
    some = lambda k: " ".join("v%d" % rng.randrange(5000) for _ in range(k))
    passage, item = some(55), some(30)
    rows = [(i, some(rng.randint(20, 120))) for i in range(200)]
    rows += [(200 + i, f"{some(40)} insult{i % 3} {some(5)}") for i in range(60)]
    rows += [(300 + i, rows[i][1] + " x") for i in range(5)] + [(310, rows[3][1])]
    rows += [(320 + i, f"{some(30)} {passage} {some(30)}") for i in range(4)] + [(330, f"{some(9)} {item} {some(9)}")]
    rows += [(340, None), (341, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7) for i, t in rows],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint, `_row` int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(200 <= i < 260)) for i, _ in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, steps = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == docs.columns
        steps[name], docs = after, after
    text = {k: {r["doc_id"]: r["text"] for r in d.collect()} for k, d in steps.items() if "text" in d.columns}
    assert set(text["toxicity"]) == {i for i, _ in rows if not 200 <= i < 260}
    kept = {r[0] for r in brute.near_duplicates(list(text["toxicity"].items())) if r[3]}
    assert set(text["near_dedup"]) == kept and 310 not in kept
    cut = {r[0]: r for r in brute.dedup_words(list(text["near_dedup"].items()))}
    for i, t in text["substring_dedup"].items():
        before = text["near_dedup"][i]
        assert t == before if not cut[i][2] else brute.sha(t.encode()) == cut[i][3]
    assert sum(c[2] for c in cut.values()) == 4 * 55
    hit = {r[0] for r in brute.contaminated(list(text["substring_dedup"].items()), [(1, item)]) if r[5]}
    assert hit == {330} and set(text["decontamination"]) == set(text["substring_dedup"]) - hit
    last = steps["sentencepiece"].collect()
    assert {r["doc_id"] for r in last} == set(text["decontamination"]) and all(r["round_trip"] for r in last)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(last)


def test_pipeline_of_repeated_rows_and_clashing_columns(spark, tmp_path):
    """One row of a full repeat stays, whole; ids that repeat or are null do not mix texts."""
    some = lambda k, n: " ".join("%s%d" % (k, i) for i in range(n))
    rows = [(1, some("a", 60))] * 3 + [(2, some("b", 50)), (2, some("c", 50)), (3, some("c", 50) + " x")]
    rows += [(None, some("d", 60)), (None, some("d", 60)), (9, some("d", 60)), (4, None), (4, None), (5, "")]
    extra = "_cut _kept _toxic_score _Toxic_Score_ _row _hit _gone _rest number id component_id first kept n_removed tid".split()
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), *(str(k) for k in range(len(extra)))) for i, t in rows],
        "doc_id bigint, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in extra),
    )
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted([(1, rows[0][1]), (2, rows[3][1]), (2, rows[4][1]), (9, rows[8][1]), (4, None), (4, None), (5, "")], key=str)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and after.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "toxicity":
            assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str) == want
    assert all(r["tid"] == str(extra.index("tid")) for r in docs.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(want)


def test_near_dedup_stage_takes_five_words(spark):
    """Three of 115 words changed: 0.81 of the shingles of four words, 0.76 of those of five."""
    words = ["w%d" % i for i in range(115)]
    other = ["x" if i in (20, 50, 80) else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words) + " y")]
    kept = {k: {r[0] for r in brute.near_duplicates(rows, size=k) if r[3]} for k in (4, 5)}
    assert kept == {4: {1}, 5: {1, 2}}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == kept[5]


def test_registration():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert len([n for n in names if re.match(r"op\d+_", n)]) == 13 and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
