import datetime as dt
import random

from pyspark.sql import functions as F

from corpuskit.operators import follow as W
from corpuskit.queries import texts
from corpuskit.streaming import follow_stream as S


def grams(tokens):
    return ["".join(tokens)] if len(tokens) < 3 else ["".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)]


def dice(a, b):
    left = list(b)
    hits = 0
    for g in a:
        if g in left:
            left.remove(g)
            hits += 1
    return 2 * hits / (len(a) + len(b))


def brute(corpus, heard, hint, min_score, near):
    win = min(max(len(heard), 4), 14)
    own = grams(heard[-win:])

    def best(lo, hi):
        top = (-1.0, None)
        for s in range(max(lo, 0), len(corpus)):
            if s + win > min(hi, len(corpus) - 1) + 1:
                break
            score = dice(own, grams(corpus[s : s + win]))
            if score > top[0] + 1e-12:
                top = (score, s)
        return top

    if hint is not None:
        score, s = best(int(max(0, hint - near / 2)), hint + near)
        if score >= min_score:
            return s, s + win, round(score, 9)
    score, s = best(0, len(corpus) - 1)
    return (s, s + win, round(score, 9)) if score >= min_score else None


def test_best_window_equals_brute_force(spark):
    rng = random.Random(7)
    corpora = {t: [rng.choice("abcd") for _ in range(300)] for t in ("x", "y")}
    asks = []
    for i in range(40):
        t = rng.choice("xy")
        s = rng.randrange(280)
        heard = list(corpora[t][s : s + rng.randrange(1, 20)])
        if rng.random() < 0.5 and len(heard) > 2:
            heard[rng.randrange(len(heard))] = "z"
        asks.append((i, t, heard, rng.choice([None, s, 40])))
    rows = [(t, p, tok) for t, toks in corpora.items() for p, tok in enumerate(toks)]
    corpus = spark.createDataFrame(rows, "text_slug string, pos bigint, token string")
    heard = spark.createDataFrame(asks, "utt_id int, text_slug string, tokens array<string>, hint bigint")
    got = {r.utt_id: (r.start, r.end, round(r.score, 9)) for r in W.best_window(heard, W.corpus_grams(corpus, width=16), 0.25, 20).collect()}
    for i, t, tokens, hint in asks:
        assert got.get(i) == brute(corpora[t], tokens, hint, 0.25, 20), i


def test_corpus_tokens_are_one_stream(spark):
    units = spark.createDataFrame([("t", "b", 2, "ग घ"), ("t", "a", 1, "क ख"), ("t", "e", 3, "latin")], "text_slug string, unit_id string, ord bigint, body string")
    got = [(r.pos, r.token, r.unit_id, r.unit_offset) for r in W.corpus_tokens(units, "ord").orderBy("pos").collect()]
    assert got == [(0, "क", "a", 0), (1, "ख", "a", 1), (2, "ग", "b", 0), (3, "घ", "b", 1)]


def test_revise():
    buf, fin = S.revise([], ["a", "b"], False)
    assert buf == ["a", "b"]
    buf, fin = S.revise(buf, ["x", "y", "z"], False, finals=fin)
    assert buf == ["x", "y", "z"]
    buf, fin = S.revise(["f1", "f2"], ["i"], False, finals=2)
    assert buf == ["f1", "i"]
    buf, fin = S.revise(["f1", "f2"], ["i"], False, strict=True, finals=2)
    assert buf == ["f1", "f2", "i"]
    buf, fin = S.revise([str(i) for i in range(80)], ["new"], True, finals=80)
    assert len(buf) == 80 and buf[-1] == "new" and buf[0] == "1"


def test_stream_follows_a_session(spark, tmp_path):
    import json

    t0 = dt.datetime(2024, 1, 1)
    events = [("s", 0, "क ख ग घ", False), ("s", 1, "क ख ग घ ङ", True), ("r", 2, "च छ", True), ("s", 3, "च छ ज", True)]
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in" / "e.json", "w", encoding="utf8") as f:
        for s, i, text, final in events:
            f.write(json.dumps({"session_id": s, "ts": (t0 + dt.timedelta(seconds=i)).isoformat(), "seq": i, "transcript": text, "is_final": final}) + "\n")
    from corpuskit.sources.files import utterance_stream

    letters = [chr(c) for c in range(0x0915, 0x0939)]
    units = spark.createDataFrame([("t", "u1", 1, " ".join(letters[:10])), ("t", "u2", 2, " ".join(letters[10:]))], "text_slug string, unit_id string, ord bigint, body string")
    corpus = W.corpus_tokens(units, "ord")
    sessions = spark.createDataFrame([("s", "t", None), ("r", "t", None)], "session_id string, text_slug string, hint bigint")
    seen = []
    query = S.follow_stream(
        utterance_stream(spark, str(tmp_path / "in")), sessions, W.corpus_grams(corpus), corpus, lambda df, epoch: seen.extend(df.collect())
    )
    run = query.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    run.awaitTermination()
    got = {r.seq: (r.unit_id, r.start, round(r.score, 6)) for r in seen}
    # A final hypothesis is appended to the interim one before it, so the buffer of 1 holds both.
    assert got[0] == ("u1", 0, 1.0) and got[1] == ("u1", 0, round(2 * 3 / 14, 6)) and got[3][0] == "u1"
    assert 2 not in got


def write_batches(path, batches):
    import json
    import os

    path.mkdir()
    for i, rows in enumerate(batches):
        (path / f"{i}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(path / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken by age


def test_latest_stream_keeps_no_state_and_drops_removed_keys(spark, tmp_path):
    schema = "user string, place int, ts long, gone boolean"
    batches = [
        [{"user": "a", "place": 1, "ts": 1, "gone": False}, {"user": "b", "place": 5, "ts": 1, "gone": False}],
        [{"user": "a", "place": 2, "ts": 3, "gone": False}, {"user": "b", "place": 5, "ts": 2, "gone": True}],
        [{"user": "a", "place": 9, "ts": 2, "gone": False}, {"user": "c", "place": 7, "ts": 1, "gone": None}],
    ]
    write_batches(tmp_path / "in", batches)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    S.run_available(S.latest_stream(stream, ["user"], ["ts"], str(tmp_path / "out")), str(tmp_path / "log"))
    got = S.latest_rows(spark, str(tmp_path / "out"), ["user"], ["ts"], stream.schema, "gone")
    assert sorted((r.user, r.place) for r in got.collect()) == [("a", 2), ("c", 7)]
    assert len(list((tmp_path / "out").glob("epoch=*"))) == 3


def test_debounce_over_micro_batches(spark, tmp_path):
    def event(user, second, n):
        return {"user": user, "ts": f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}.000", "n": n}

    batches = [[event("a", 0, 1), event("a", 0, 2), event("b", 1, 3)], [event("a", 5, 4), event("b", 1, 5)], [event("a", 6, 6), event("z", 3000, 7)], [event("z", 3001, 8)]]
    write_batches(tmp_path / "in", batches)
    stream = spark.readStream.schema("user string, ts timestamp, n long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    closed = S.debounce_stream(stream, ["user"], "ts", "n", gap_ms=2000)
    S.run_available(S.into_folder(closed, str(tmp_path / "out")), str(tmp_path / "log"))
    got = sorted((r.user, r.n) for r in spark.read.schema(closed.schema).parquet(str(tmp_path / "out")).collect())
    # z's newest event still waits; a's and b's last ones were closed by the watermark
    assert got == [("a", 2), ("a", 6), ("b", 5)]


def test_every_text_is_searched(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 40")
    docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").otherwise(F.col("lang"))).write.parquet(str(tmp_path / "documents.parquet"))
    docs.limit(3).selectExpr("doc_id AS item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    corpus = W.corpus_grams(texts.stream_tokens(spark, str(tmp_path)))
    asked = texts.heard(spark, str(tmp_path), F.lit(None))
    assert "text_slug" not in asked.columns
    slugs = {r.text_slug for r in corpus.select("text_slug").distinct().collect()}
    assert "xx" in slugs
    # a passage that every text holds is found in every text
    own = corpus.sparkSession.createDataFrame([(s, p, t) for s in slugs for p, t in enumerate("one two three four five six".split())], "text_slug string, pos bigint, token string")
    both = corpus.unionByName(W.corpus_grams(own).withColumn("gpos", F.col("gpos") + 10_000_000))
    everywhere = corpus.sparkSession.createDataFrame([(1, "one two three four five six".split(), None)], "utt_id int, tokens array<string>, hint bigint")
    assert {r.text_slug for r in W.best_window(everywhere, both).collect()} == slugs
    assert "xx" in {r.text_slug for r in texts.best_window(spark, str(tmp_path)).collect()}


def test_matches_move_the_hint(spark, tmp_path):
    """Interim and final rows over several micro-batches give the rows of one batch, each match being the next one's hint."""
    words = [f"w{i}" for i in range(400)] + [f"w{i}" for i in range(100, 130)]  # 100 to 129 occur twice
    corpus = spark.createDataFrame([("t", i, w, f"u{i // 50}", i % 50) for i, w in enumerate(words)], "text_slug string, pos bigint, token string, unit_id string, unit_offset int")
    index = W.build_index(W.corpus_grams(corpus), stored=True)
    said = [("a", words[300:308], True), ("a", words[306:311], False), ("b", words[100:110], True), ("a", words[380:390], True), ("a", words[100:112], True), ("a", ["x"] * 14, True), ("a", words[402:412], True), ("b", words[104:116], True)]
    rows = [{"session_id": s, "ts": f"2024-01-01T00:00:{i:02d}.000", "seq": i, "transcript": " ".join(w), "is_final": f} for i, (s, w, f) in enumerate(said)]
    sessions = spark.createDataFrame([("a", "t"), ("b", "t")], "session_id string, text_slug string")
    got = {}
    for name, batches in (("one", [rows]), ("many", [rows[:3], rows[3:5], rows[5:7], rows[7:]])):
        write_batches(tmp_path / name, batches)
        stream = spark.readStream.schema("session_id string, ts timestamp, seq long, transcript string, is_final boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / name))
        root = str(tmp_path / f"{name}-out")
        S.run_available(S.match_stream(stream, sessions, index, root, tokens=texts.T.space_tokens), f"{root}/log")
        found = S.matches_of(spark, root, corpus).select("session_id", "seq", "unit_id", "start", "end", "is_local").collect()
        got[name] = sorted(tuple(r) for r in found)
    assert got["one"] == got["many"]
    # near the end of the text the second copy of the repeated words wins, without a hint the first
    starts = {r[1]: (r[3], r[5]) for r in got["one"]}
    assert starts[2] == (100, False) and starts[4][0] >= 396 and starts[4][1] and starts[7][1] and 5 not in starts


def test_unit_index_equals_the_index_of_the_grams(spark):
    """Blocks made of whole units hold the grams, lengths and positions of the token stream, over units of one token and long ones."""
    sizes = [1, 1, 2, 200, 1, 63, 64, 65, 1, 1, 3]
    rows = [(slug, i, " ".join(f"w{(i * 7 + k * k) % 11}" for k in range(n))) for slug in ("a", "b") for i, n in enumerate(sizes if slug == "a" else [2, 1, 0])]
    units = spark.createDataFrame([*rows, ("c", 0, "one two")], "text_slug string, unit_id long, body string")
    cut = lambda c: W.T.split_nonempty(c, " ")
    corpus, placed = W.corpus_tokens(units, "unit_id", cut), W.placed_units(units, "unit_id", cut)
    want, got = W.build_index(W.corpus_grams(corpus)), W.unit_index(placed)
    assert sorted(map(tuple, got.grams.select("text_slug", "gpos", "gram").collect())) == sorted(map(tuple, want.grams.select("text_slug", "gpos", "gram").collect()))
    in_blocks = lambda blocks: sorted(map(tuple, blocks.select("text_slug", "block", "text_len", "grams").collect()))
    assert in_blocks(W._with_grams(got.blocks)) == in_blocks(want.blocks)


def test_heard_writer_equals_revise(spark, tmp_path):
    """Buffers over several micro-batches, small ones in Python and signs of its own among the tokens included, are those of ``revise``; an idle session is forgotten."""
    import random

    draw = random.Random(1)
    words = ["a", "b\x1fc", "\x1b", "\x1b1", "", "d"]
    said = [(draw.choice("xyz"), i, [draw.choice(words) for _ in range(draw.randint(1, 4))], draw.random() < 0.6) for i in range(90)]
    said = [*said, ("x", 100_000, ["late"], True), ("y", 200_000, ["later"], True), ("x", 200_001, ["again"], False)]
    batches = [said[:40], said[40:90], said[90:91], said[91:]]
    rows = [[{"session_id": s, "ts": f"{dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i)}", "seq": i, "transcript": "|".join(w), "is_final": f} for s, i, w, f in batch] for batch in batches]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # sessions go on over many Arrow batches
    try:
        for strict in (False, True):
            write_batches(tmp_path / f"in{strict}", rows)
            stream = spark.readStream.schema("session_id string, ts timestamp, seq long, transcript string, is_final boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / f"in{strict}"))
            root = str(tmp_path / f"out{strict}")
            S.run_available(S.heard_writer(stream, root, tokens=lambda c: F.split(c, "[|]"), idle_minutes=1500, size=6, strict=strict), f"{root}/log")
            got = {(r.session_id, r.seq): r.heard for r in S.heard_of(spark, root).collect()}
            state, want = {}, {}
            for s, i, w, f in said:
                if i == 200_001:  # x was last heard 1,667 minutes before the newest row of the last micro-batch but was not idle in the one before
                    assert state["x"][0][-1] == "late"
                state[s] = S.revise(state.get(s, ([], 0))[0], w, f, 6, strict, state.get(s, ([], 0))[1])
                if i == 100_000:  # 1,667 minutes after all others
                    state = {"x": state["x"]}
                want[(s, i)] = state[s][0]
            assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_batch_of_many_files_is_one_micro_batch(spark, tmp_path):
    """The events are written by as many tasks as read them, and the stream takes them in the order of time."""
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i % 7, "view", 1.0, "") for i in range(600)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    _, root, batches = texts.event_batches(spark, str(tmp_path))
    assert batches[0].rdd.getNumPartitions() > 1
    got = {r.event_id: r.n_buffered for r in texts.stream_follow(spark, str(tmp_path)).collect()}
    assert got == {i: min(i // 7 + 1, 80) for i in range(600)}


def test_copies_of_a_phrase_are_not_all_scored(spark, monkeypatch):
    """The first of equal windows is found without a look at every copy; a better one far behind is found all the same."""
    phrase = [f"p{i}" for i in range(20)]
    words = [w for n in range(300) for w in [*phrase, f"x{n}", f"y{n}", f"z{n}"]]
    corpus = spark.createDataFrame([("t", i, w) for i, w in enumerate(words)], "text_slug string, pos bigint, token string")
    index = W.build_index(W.corpus_grams(corpus), stored=True)
    heard = [(1, "t", phrase[3:17]), (2, "t", [*phrase[10:], "x250", "y250", "z250"]), (3, "t", [*phrase[:7], *phrase[:7]]), (4, "t", ["p0", "p1"] * 7), (5, "t", ["a"] * 14)]
    asked = W.utterances(spark.createDataFrame(heard, "utt_id int, text_slug string, tokens array<string>"))
    scored, seen = W._scored, []
    monkeypatch.setattr(W, "_scored", lambda met, least: seen.append(met.filter("utt_id <> 3").count()) or scored(met, least))
    got = {r.utt_id: (r.start, r.start + r.win, round(r.score, 9)) for r in W.best_windows(asked, index).collect()}
    want = {i: brute(words, tokens, None, 0.25, 0) for i, _, tokens in heard}
    assert got == {i: w for i, w in want.items() if w} and got[2][0] == 250 * 23 + 10 and len(got) == 3
    assert seen[0] < 40  # the text has 108 blocks with the phrase; that of 3, which says it twice, is looked for in all


def test_a_walk_goes_on_where_its_text_ends(spark):
    """Matches that follow the hint through the second of two copies, away from all first best windows, are found in several rounds."""
    words = [f"w{i}" for i in range(1500)] * 2
    corpus = spark.createDataFrame([("t", i, w) for i, w in enumerate(words)], "text_slug string, pos bigint, token string")
    index = W.build_index(W.corpus_grams(corpus), stored=True)
    t0 = dt.datetime(2024, 1, 1)
    said = [(s, t0 + dt.timedelta(seconds=i), i, "t", words[i * 40 : i * 40 + 14]) for i in range(30) for s in "ab"]
    asked = spark.createDataFrame(said, "session_id string, ts timestamp, seq long, text_slug string, tokens array<string>")
    hints = spark.createDataFrame([("a", 1500)], "session_id string, hint long")
    got = {(r.session_id, r.seq): (r.start, r.end, r.score, r.is_local) for r in S.moving_matches(asked, hints, index).collect()}
    assert got == {(s, i): (i * 40 + (1500 if s == "a" else 0), i * 40 + 14 + (1500 if s == "a" else 0), 1.0, s == "a" or i > 0) for i in range(30) for s in "ab"}
