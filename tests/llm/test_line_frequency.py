import re
from collections import Counter, defaultdict

from corpuskit.llm import line_frequency as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, max_docs=10):
    """The same rules row by row in plain Python."""
    seen, first = Counter(), {}
    norm = lambda x: re.sub("[0-9]", "0", " ".join(WORD.findall(x)).lower())
    parsed = []
    for doc_id, text, host in rows:
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        parsed.append(lines)
        for key in {(host, norm(x)) for x in lines}:
            seen[key] += 1
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for (doc_id, text, host), lines in zip(rows, parsed):
        words = WORD.findall(text or "")
        grams = defaultdict(list)
        for i in range(len(words) - 2):
            grams[tuple(words[i : i + 3])].append(i)
        repeated = {j for at in grams.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
        removed = 0
        for x in lines:
            key = (host, norm(x))
            if seen[key] > max_docs and (doc_id is None or doc_id != first.get(key)):
                removed += len(WORD.findall(x))
        n = len(words)
        failed = n < 50 or 100 * len(repeated) > 50 * n
        left = n - removed
        out.append((doc_id, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed, removed, not failed and left >= 50 and left >= 0.3 * n))
    return sorted(out, key=repr)


def test_brute_force(spark, sf, odd_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*odd_docs.columns[:5]).unionByName(odd_docs.drop("fp"))
    # a line that 40 documents of one host share, and a host where it is rare
    shared = spark.range(10_000, 10_060).selectExpr("id AS doc_id", "concat('Shared LINE 12 of ', repeat('boiler plate text and so on ', 12), '\n', if(id % 3 = 0, '', array_join(transform(sequence(1, 60), i -> concat('w', id * i)), ' '))) AS text", "'en' AS lang", "if(id < 10040, 'hot', 'cold' || id % 4) AS source", "1L AS n_chars")
    docs = docs.unionByName(shared)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for frame in (docs, docs.repartition(7)):
        got = sorted((tuple(r) for r in L.judge(frame).collect()), key=repr)
        assert got == brute(rows)
    assert sum(1 for r in got if r[7] > 0) >= 39


def test_empty_and_native(spark, no_docs, odd_docs):
    assert L.judge(no_docs).count() == 0
    plan = L.judge(odd_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_the_limit_is_the_same_for_every_host_size(spark):
    """A line of 11 documents is removed from a host of 11 as from one of 30,000 documents."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat(if(id < 11, 'the same line of some words\n', ''), 'own line ', repeat(concat('a', uuid(), ' '), 3)) AS text", "'big' AS source")
    got = L.judge(docs).filter("removed_words > 0").collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 11)) and {r.removed_words for r in got} == {6}
