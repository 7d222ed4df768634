"""The training-data operators on small notices: brute force, round trips and odd rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fairlead.llm import exact_dedup, line_dedup, ngram_join, packing, pseudo_likelihood, quality, sentencepiece_codec
from fairlead.llm import token_counts, token_files, url_rules
from fairlead.llm.components import connected_components
from fairlead.session import shared_dir

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

RNG = np.random.default_rng(7)
VOCABULARY = ["".join(RNG.choice(list("aeioubcdfglmnprstvé"), size=int(n))) for n in RNG.integers(2, 9, 400)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY, size=n))


LONG = "\n".join(prose(40) + "." for _ in range(120))
BASE = prose(60)
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "Queue at the Bridge"), (5, "queue at the bridge"), (5, "queue at the bridge"),
    (6, "QUEUE AT THE BRIDGE"), (None, "no key here"), (None, "queue at the bridge"), (7, LONG), (8, LONG.upper()),
    (9, BASE), (10, BASE + " late"), (11, "x " + BASE), (12, "É é ß ſ K İ ﬁ \x00 日本語 🎉🎉  double  space ▁ <|endoftext|> <s> <0x0A>"),
    (13, "a"), (14, "\n".join(["same line here again"] * 9)), (15, prose(30) + "\n" + prose(30)), (16, "#$%&|<>* " * 30),
    (17, "word " * 5000), (18, "ab\u0301c don't I'll 123 45\x85x\u00a0y\x1cz"),
]
EXTRA = ["key", "text", "row", "name", "n", "cls", "kept", "sequence_id", "offset", "field", "a", "b"]


@pytest.fixture(scope="module")
def notices(spark):
    rows = [(k, t, *["clash"] * len(EXTRA)) for k, t in ODD]
    return spark.createDataFrame(rows, "metric_id bigint, construction_notice string, " + ", ".join(f"{c} string" for c in EXTRA)).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(notices):
    return notices.filter("false")


def by_key(df):
    return sorted(df.collect(), key=lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, (list, dict)) else str(v) for v in r))


def rows_of(data, columns):
    return sorted(((r[c] for c in columns) for r in data), key=str)


# --- 1: SentencePiece ------------------------------------------------------------------------


def test_sentencepiece_equals_the_library(spark, notices):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sentencepiece_codec.decode_notices(sentencepiece_codec.encode_notices(notices, PIECES), PIECES).collect()
    want = []
    for k, t in ODD:
        ids = library.encode(t or "")
        want.append((k, len(ids), ",".join(map(str, ids)), library.decode(ids) if ids else ""))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_prefix_table_on_random_strings():
    table = sentencepiece_codec.PrefixTable(PIECES)
    letters = list("aeiouthnsrl ▁.,\n\té日😀")
    for _ in range(1500):
        text = "".join(RNG.choice(letters, size=int(RNG.integers(0, 50))))
        assert table.encode(text) == ",".join(map(str, table.library.encode(text))), repr(text)


def test_sentencepiece_of_nothing(nothing):
    assert sentencepiece_codec.decode_notices(sentencepiece_codec.encode_notices(nothing, PIECES), PIECES).count() == 0


# --- 2: token counts -------------------------------------------------------------------------


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_add_up_and_follow_the_rule(spark, rule):
    import tiktoken
    import base64

    records = [(1, "Bridge", "open", "lane one\n\n\n  lane two é日本😀"), (2, None, None, None), (2, "x", "", "   \n  y"), (None, "a", "b", prose(50))]
    df = spark.createDataFrame(records, "metric_id bigint, display_name string, port_status string, construction_notice string")
    got = token_counts.token_counts(df, RANKS, public_tokenizers.PATTERN, rule=rule).collect()
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for key, *values in records:
        values = [v or "" for v in values]
        lines = values[2].split("\n")
        parts = [("display_name", 0, values[0] + "\n"), ("port_status", 0, values[1] + "\n")]
        parts += [("construction_notice", i, x + ("\n" if i < len(lines) - 1 else "")) for i, x in enumerate(lines)]
        text = "".join(p[2] for p in parts)
        owner = [i for i, p in enumerate(parts) for _ in p[2]]
        of_byte = [c for c, ch in enumerate(text) for _ in ch.encode()]
        counts, across, at = [0] * len(parts), [0] * len(parts), 0
        for token in enc.encode_ordinary(text):
            size = len(enc.decode_single_token_bytes(token))
            chars = sorted(set(of_byte[at:at + size]))
            owners = [owner[c] for c in chars]
            best = owners[0] if rule == "first" else owners[-1] if rule == "last" else max(dict.fromkeys(owners), key=owners.count)
            counts[best] += 1
            across[best] += len(set(owners)) > 1
            at += size
        want += [(key, f, i, len(t), n, x) for (f, i, t), n, x in zip(parts, counts, across)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# --- 3: exact duplicates ---------------------------------------------------------------------


@pytest.mark.parametrize("block,digest", [(8192, exact_dedup._digest), (7, exact_dedup._digest), (16, lambda b: bytes([sum(b) % 3]))])
def test_exact_duplicates(notices, block, digest):
    got = exact_dedup.exact_duplicates(notices, block_bytes=block, digest=digest).collect()
    groups = defaultdict(list)
    low = lambda t: (t or "").encode().lower()
    for k, t in ODD:
        groups[low(t)].append(k)
    assert len(got) == len(ODD)
    want = sorted(((k, max((x for x in groups[low(t)] if x is not None), default=None), len(groups[low(t)]), hashlib.sha256(low(t)).hexdigest()) for k, t in ODD), key=str)
    assert sorted(((r.metric_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.metric_id == r.keep_id for r in got if r.kept)
    assert len({(r.level, r.name) for r in got}) == len(groups)


def test_exact_duplicates_of_nothing(nothing):
    assert exact_dedup.exact_duplicates(nothing).count() == 0


# --- 4: pseudo-likelihood --------------------------------------------------------------------


def test_scores_prefer_the_order_of_the_corpus(spark):
    rng = np.random.default_rng(3)
    nouns, verbs = [f"noun{i}" for i in range(20)], [f"verb{i}" for i in range(20)]
    say = lambda: " ".join(w for _ in range(30) for w in ("the", rng.choice(nouns), rng.choice(verbs), "now"))
    texts = [say() for _ in range(200)]
    held = [say() for _ in range(20)]
    mixed = [" ".join(rng.permutation(t.split())) for t in held]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(held)] + [(2000 + i, t) for i, t in enumerate(mixed)]
    rows += [(3000, None), (3001, ""), (None, "the noun1"), (0, texts[0])]
    got = pseudo_likelihood.notice_scores(spark.createDataFrame(rows, "metric_id bigint, construction_notice string")).collect()
    assert len(got) == len(rows)
    mean = {r.metric_id: r.mean_log_likelihood for r in got}
    wins = sum(mean[1000 + i] > mean[2000 + i] for i in range(20))
    assert wins == 20 and mean[3000] is None and mean[3001] is None
    assert len({r.log_likelihood for r in got if r.metric_id == 0}) == 1


def test_counts_of_words_that_are_not_sent_out_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) % 3000)) for i in range(120)] + [(200, ""), (None, "w1 w2999 w2999")]
    df = spark.createDataFrame(rows, "metric_id bigint, construction_notice string")
    want = by_key(pseudo_likelihood.notice_scores(df))
    monkeypatch.setattr(pseudo_likelihood, "KNOWN", 150)
    got = by_key(pseudo_likelihood.notice_scores(df))
    assert [(r.metric_id, r.n_words) for r in got] == [(r.metric_id, r.n_words) for r in want]
    assert np.allclose([r.log_likelihood for r in got], [r.log_likelihood for r in want], rtol=1e-9, atol=1e-7)


def test_scores_of_nothing(nothing):
    assert pseudo_likelihood.notice_scores(nothing).count() == 0


# --- 5: token files --------------------------------------------------------------------------


def word_tokens(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids


def test_levels_round_trip_and_random_access():
    for high in (1, 200, 5000, 70_000, 1 << 32):
        for n in (0, 1, 511, 512, 513, 3000):
            ids = RNG.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            levels = token_files.encode_levels(ids)
            assert (token_files.decode_levels(levels, n) == ids).all()
            at = RNG.integers(0, max(n, 1), 200) if n else np.zeros(0, np.int64)
            assert (token_files.ids_at(levels, at) == ids[at]).all()


def test_token_files_give_back_the_library_ids(spark, notices, nothing, monkeypatch):
    path = shared_dir(spark, "files")
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 1000)
    token_files.write_token_files(notices, path, WORDS, end_id=2)
    got = token_files.read_token_files(spark, path).collect()
    want = sorted((k is not None, k or 0, np.asarray(word_tokens(t) + [2], "<u4").tobytes()) for k, t in ODD)
    assert sorted((r.metric_id is not None, r.metric_id or 0, bytes(r.token_ids)) for r in got) == want
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    keys = [r.metric_id for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    every = np.concatenate([np.frombuffer(r.token_ids, "<u4") for r in sorted(got, key=lambda r: r.start)])
    asked = [0, 1, 5, len(every) - 1, len(every) // 2, len(every), -1]
    found = token_files.tokens_at(spark.createDataFrame([(a,) for a in [*asked, 5, None]], "position bigint"), path).collect()
    assert {(r.position, r.token_id) for r in found} == {(a, int(every[a])) for a in asked if 0 <= a < len(every)} and len(found) == 5
    empty = shared_dir(spark, "files")
    token_files.write_token_files(nothing, empty, WORDS)
    assert token_files.read_token_files(spark, empty).count() == 0


# --- 6: n-gram join --------------------------------------------------------------------------


def components_by_force(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[root(i)].append(k)
    return [(k, len(s), min((x for x in least[root(i)] if x is not None), default=None)) for i, ((k, _), s) in enumerate(zip(rows, sets))]


def near_copies(n, length, edits):
    base, out = list(RNG.choice(VOCABULARY, size=length)), []
    for _ in range(n):
        words = list(base)
        for at in RNG.integers(0, length, int(RNG.integers(0, edits))):
            words[at] = str(RNG.choice(VOCABULARY))
        out.append(" ".join(words))
    return out


def test_similar_notices_equal_brute_force(spark, notices):
    passage = prose(55)
    rows = list(ODD) + [(100 + i, t) for i, t in enumerate(near_copies(60, 80, 6) + near_copies(25, 12, 3))]
    rows += [(300 + i, prose(20) + " " + passage + " " + prose(10)) for i in range(30)] + [(400 + i, prose(3)) for i in range(4)]
    df = spark.createDataFrame(rows, "metric_id bigint, construction_notice string").withColumn("cls", F.lit("x")).repartition(5)
    got = ngram_join.similar_notices(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(components_by_force(rows), key=str)


def test_similar_notices_of_nothing(nothing):
    assert ngram_join.similar_notices(nothing).count() == 0
    assert ngram_join.similar_notices(nothing.sparkSession.createDataFrame([(1, None), (2, "")], "metric_id bigint, construction_notice string")).count() == 2


def test_grams_do_not_depend_on_the_piece_size(monkeypatch):
    whole = ngram_join.gram_set(LONG)
    monkeypatch.setattr(ngram_join, "PIECE", 37)
    assert (ngram_join.gram_set(LONG) == whole).all()
    assert len(ngram_join.gram_set("w" * 500)) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 202), (201, 202)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 201: 200, 202: 200}


# --- 7: URL rules ----------------------------------------------------------------------------

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
         ("Example.NET", "/en/secret", "block"), ("net", "/long/path/here", "allow"), ("a.example.net", "/", "allow"), ("x.io", None, "block"),
         (None, "/", "block"), ("", "/", "block"), ("net", "/", "allow"), ("com", "nonsense", "block")]
URLS = [None, "", "no scheme", "http://", "http://net/", "https://EXAMPLE.net/en/x?y#z", "https://example.net", "http://a.example.net/en/1",
        "http://b.a.example.net/en/secret/2", "http://example.com/de/", "http://example.community/de/", "http://x.org/fr/1", "http://x.org/en/1",
        "ftp://notexample.net/en/", "http://deep.net/long/path/here/now", "http://x.io", "http://y.x.io?q=/en/", "http://example.net/EN/", "a://b://c.net/",
        "http://net./", "http://é.net/ü", "http://example.net\n/en/", "http://" + "s." * 300 + "net/" + "p" * 3000]


def judged_by_force(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:cut]), rest[cut:]
        path = re.split("[?#]", tail)[0]
    fits = []
    for h, p, v in RULES:
        h, p = (h or "").lower(), p or ""
        if h and host and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), h + p, v))
    rule = max(fits, default=None)
    return host, path, rule and rule[2], rule[3] if rule else "allow"


def test_url_verdicts_equal_brute_force(spark):
    rows = [(i % 20, u) for i, u in enumerate(URLS)] + [(5, URLS[5])] * 40 + [(None, "http://q.net/")]
    readings = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "metric_id bigint, record_ref string, host string, rule string, row int").repartition(4)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_rules.reference_verdicts(readings, rules).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((k, *judged_by_force(u)) for k, u in rows), key=str)
    assert url_rules.reference_verdicts(readings.limit(0), rules).count() == 0
    none = url_rules.reference_verdicts(readings, rules.limit(0)).collect()
    assert len(none) == len(rows) and {r.verdict for r in none} == {"allow"}


# --- 8: lines --------------------------------------------------------------------------------


def lines_by_force(rows):
    """Occurrences (key, text, line_no) with group and verdict, by the definitions."""
    found = {}
    for k, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            words = [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", line.lower()) if w]
            if words:
                found[(k, t or "", i)] = words
    distinct = {tuple(w) for w in found.values()}
    parent = {w: w for w in distinct}

    def root(w):
        while parent[w] != w:
            w = parent[w]
        return w

    ordered = sorted(distinct)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if similar(" ".join(a), " ".join(b)):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for place, w in found.items():
        groups[root(tuple(w))].append(place)
    return found, groups, root


def test_line_groups_equal_brute_force(spark):
    base = prose(90)
    copies = [base.replace(w, w + "s", 1) for w in base.split()[::7]]
    texts = ["\n".join([prose(12), x, "", "Short one here.", "ok", prose(9)]) for x in [base, *copies, base.upper() + "!!", base]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "Short one, here"), (50, None), (51, ""), (52, "\n\n"), (53, "word " * 400), (54, "WORD " * 400)]
    df = spark.createDataFrame(rows + [(0, texts[0])], "metric_id bigint, construction_notice string").withColumn("line_no", F.lit("x")).repartition(3)
    found, groups, root = lines_by_force(rows)
    reported = line_dedup.line_groups(df).collect()
    got = list(dict.fromkeys(reported))
    assert len(got) == len(found) and len(reported) == len(found) + sum(1 for k, t, _ in found if k == 0 and t == texts[0])
    hashes = {r.hash: r.text for r in spark.createDataFrame([(t or "",) for _, t in rows], "text string").select(F.xxhash64("text").alias("hash"), "text").collect()}
    by_group = defaultdict(set)
    for r in got:
        by_group[r.group_id].add((r.metric_id, hashes[r.text_hash], r.line_no))
    assert {frozenset(p) for p in by_group.values()} == {frozenset(p) for p in groups.values()}
    assert max(map(len, groups.values())) > 8
    kept = {(r.metric_id, hashes[r.text_hash], r.line_no) for r in got if r.kept}
    for places in groups.values():
        inside = [x for x in places if x in kept]
        assert len(inside) == 1 and inside[0][0] == min(x[0] for x in places)


def test_repeated_lines_are_taken_out(spark, nothing):
    line = "the bridge is closed for repairs until the end of the month"
    rows = [(2, f"{line}\nlane two"), (1, f"intro of three words\n\n{line}"), (3, None), (4, line), (None, "odd key row here")]
    df = spark.createDataFrame(rows, "metric_id bigint, construction_notice string").withColumn("_lines", F.lit(1))
    got = line_dedup.without_repeated_lines(df)
    assert got.columns == df.columns
    assert {(r.metric_id, r.construction_notice) for r in got.collect()} == {
        (1, rows[1][1]), (2, "lane two"), (3, None), (4, ""), (None, "odd key row here")}
    assert line_dedup.without_repeated_lines(nothing).count() == 0


def similar(a, b):
    """Edit similarity of at least 0.9, by the whole table of distances."""
    most = (100 - line_dedup.EDIT_SIMILARITY_PERCENT) * max(len(a), len(b)) // 100
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= most


def grouped_lines(spark, lines):
    """line -> group, of lines that stand in a notice each."""
    df = spark.createDataFrame(list(enumerate(lines)), "metric_id bigint, construction_notice string")
    found = {r.metric_id: r for r in line_dedup.line_groups(df).collect()}
    return [found[i].group_id for i in range(len(lines))], [found[i].kept for i in range(len(lines))]


def test_similar_lines_are_found_by_edit_similarity_alone(spark):
    """Recall against edit similarity, whatever the bits of the words: one word of 8 to 100 changed."""
    rng = np.random.default_rng(11)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size=n))
    pairs = []
    for n in [8, 10, 12, 15, 20, 25, 30, 50, 100] * 12:
        words = [word(int(k)) for k in rng.integers(3, 9, n)]
        at = int(rng.integers(n))
        pairs.append((" ".join(words), " ".join([*words[:at], word(len(words[at])), *words[at + 1:]])))
    pairs = [(a, b) for a, b in pairs if a != b and similar(a, b)]
    group, _ = grouped_lines(spark, [x for p in pairs for x in p])
    missed = sum(a != b for a, b in zip(group[::2], group[1::2]))
    assert len(pairs) > 70 and missed <= 0.01 * len(pairs) and len(set(group)) >= len(pairs)


def test_lines_of_few_words_and_of_scripts_without_spaces_are_repeats(spark):
    han = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(80))
    lines = ["Reply", "reply", "Read more", "READ MORE!", "international-arrangements", "international arrangement", "unlike",
             han, han[:40] + "一" + han[41:], "日本語", "日本語", "long" * 30, "long" * 15 + "x" + "long" * 15]
    group, kept = grouped_lines(spark, lines)
    assert group[0] == group[1] and group[2] == group[3] and group[4] == group[5] and group[7] == group[8]
    assert group[9] == group[10] and group[11] == group[12] and len(set(group)) == 7
    assert kept == [True, False, True, False, True, False, True, True, False, True, False, True, False]


def test_all_similar_short_lines_are_found(spark):
    rng = np.random.default_rng(12)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size=n))
    pairs = []
    for n in [*range(10, 50)] * 3:  # as many single edits as the length allows
        a = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size=n))
        b = list(a)
        for _ in range(n // 10):
            at, kind = int(rng.integers(len(b))), int(rng.integers(3))
            b[at:at + 1] = [[], [word(1)], [b[at], word(1)]][kind]
        pairs.append((a, "".join(b)))
    pairs = [(a, b) for a, b in pairs if a != b and len(b) < line_dedup.SEGMENT_CHARS and similar(a, b)]
    group, _ = grouped_lines(spark, [x for p in pairs for x in p])
    assert len(pairs) > 70 and group[::2] == group[1::2] and len(set(group)) == len(pairs)


# --- 9: quality ------------------------------------------------------------------------------


def repeats_by_force(words):
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i:i + 8])].append(i)
    return len({i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)})


def test_quality_counts_and_bands(spark, notices, nothing):
    got = quality.notice_quality(notices).collect()
    assert len(got) == len(ODD)
    want = []
    for k, t in ODD:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n, rep = len(words), repeats_by_force(words)
        want.append((k, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n))
    names = ("metric_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == sorted(want, key=str)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.notice_quality(nothing).count() == 0


def test_repetitive_and_incompressible_texts_are_rejected(spark):
    rng = np.random.default_rng(5)
    noise = " ".join("".join(map(chr, rng.integers(0x30, 0x7B, 40))) for _ in range(400))
    cycle = " ".join(f"{a}{b}" for a in ("alpha ", "alpha  ", "alpha   ") for b in range(1000, 1400))
    half = LONG[:5000] + " " + " ".join(f"line {i % 10} of" for i in range(6000))
    rows = [(1, LONG), (2, noise), (3, cycle), (4, half), (5, prose(25))]
    got = {r.metric_id: r for r in quality.notice_quality(spark.createDataFrame(rows, "metric_id bigint, construction_notice string")).collect()}
    assert got[1].kept and got[5].kept and not got[2].kept and got[2].reject_reason == "incompressible"
    assert not got[3].kept and not got[4].kept
    df = spark.createDataFrame(rows, "metric_id bigint, construction_notice string").withColumn("kept", F.lit("x"))
    assert [r.metric_id for r in quality.kept_notices(df).orderBy("metric_id").collect()] == [1, 5]


# --- 10: packing -----------------------------------------------------------------------------


def test_packed_pieces_fill_sequences_without_gaps(spark, notices, nothing):
    pieces = packing.token_pieces(notices, WORDS, capacity=64, key="metric_id")
    placed = packing.pack_pieces(pieces.withColumn("sequence_id", F.lit("clash")), capacity=64)
    got = placed.collect()
    ids = defaultdict(list)
    for k, t in ODD:
        data = word_tokens(t) + [0]
        for i in range(0, len(data), 64):
            ids[(k, i // 64)].append((i, data[i:i + 64]))
    assert sorted(((r.metric_id, r.piece, r.start, list(np.frombuffer(r.token_ids, "<u4"))) for r in got), key=str) == sorted(
        ((k, i, s, d) for (k, i), v in ids.items() for s, d in v), key=str)
    whole = defaultdict(list)
    for r in got:
        whole[r.sequence_id].append((r.offset, r.length))
    for parts in whole.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(whole) <= 1.02 * sum(r.length for r in got) / 64 + 1
    full = {r.sequence_id: bytes(r.token_ids) for r in packing.packed_sequences(placed).collect()}
    for r in got:
        assert full[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == bytes(r.token_ids)
    assert packing.pack_pieces(packing.token_pieces(nothing, WORDS)).count() == 0
    with pytest.raises(ValueError):
        packing.pack_pieces(spark.createDataFrame([(1, 99)], "metric_id bigint, length bigint"), capacity=64)


@pytest.mark.parametrize("counts,capacity,most", [
    ({5: 7, 3: 7, 2: 7}, 10, 7), ({10: 4}, 10, 4), ({1: 25}, 10, 3), ({6: 10, 2: 20}, 10, 10), ({4: 3, 3: 4, 7: 3}, 10, 5), ({}, 10, 0)])
def test_plans_use_every_piece_once(counts, capacity, most):
    plan = packing.plan_sequences(counts, capacity)
    used = defaultdict(int)
    for lengths, times in plan:
        assert sum(lengths) <= capacity and times > 0
        for x in lengths:
            used[x] += times
    assert used == counts and sum(t for _, t in plan) <= most


def test_crc_of_ids_is_unsigned(spark):
    row = spark.createDataFrame([(bytes(range(8)),)], "ids binary").select(F.crc32("ids").alias("c")).first()
    assert row.c == zlib.crc32(bytes(range(8)))


def test_pieces_are_written_before_they_are_numbered(spark, monkeypatch):
    """Encoding and numbering in one stage gave each core two Python workers with word tables."""
    import __spark_entry__ as entry
    import corpus_pipeline
    from conftest import SMALL

    seen, numbered = [], packing._numbered
    monkeypatch.setattr(packing, "_numbered", lambda pieces, length: seen.append(pieces) or numbered(pieces, length))
    rows = entry.queries()["op10_pack_sequences"](spark, SMALL)
    corpus_pipeline.packed_sequences(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    assert len(seen) == 2 and rows.count() == seen[0].count()
    assert not [p for p in seen if "MapInArrow" in p._jdf.queryExecution().toString()]


def test_line_dedup_keeps_no_table_that_is_not_read_any_more(notices, tmp_path, monkeypatch):
    from fairlead import session

    numbers = iter(range(1000))
    for module in (session, line_dedup):
        monkeypatch.setattr(module, "shared_dir", lambda spark, label: f"{tmp_path}/{label}-{next(numbers)}")
    left = lambda: [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir() if not p.name.startswith(("links", "minima", "large", "small"))]
    groups = line_dedup.line_groups(notices)
    assert {"lines", "decided-lines"} <= set(left()) <= {"lines", "decided-lines", "line-links", "line-components"}
    assert groups.count() > 0
    cleaned = line_dedup.without_repeated_lines(notices.drop("key"))
    assert cleaned.count() == notices.count()
    assert left().count("lines") == left().count("decided-lines") == left().count("dropped-lines") == 1


def test_lines_of_many_blocks_in_common_make_one_pair(spark, monkeypatch):
    """Near copies share most of their blocks; what is left between components is paired once, and no pair is lost."""
    words = BASE.split()
    lines = [" ".join(w if RNG.random() > 0.12 else f"{w[::-1]}{i}" for w in words) for i in range(60)]
    seen, across = [], line_dedup._pairs_across
    monkeypatch.setattr(line_dedup, "_pairs_across", lambda rows: seen.append((rows.cache(), rows.count())) or across(rows))
    line_dedup.line_groups(spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "metric_id long, construction_notice string")).count()
    rows, many = seen[0]
    x, y = rows.alias("x"), rows.alias("y")
    apart = (F.col("x.line_hash") < F.col("y.line_hash")) & (F.col("x.root") != F.col("y.root"))
    every = x.join(y, (F.col("x.block") == F.col("y.block")) & apart & line_dedup._possible("x", "y")).select("x.line_hash", "y.line_hash").collect()
    made = [(min(p), max(p)) for p in across(rows).collect()]
    assert set(made) == {tuple(p) for p in every} and len(made) == len(set(made))
    assert many and len(every) > len(made) > 0


def test_lines_are_ruled_out_without_shuffling_texts(spark, monkeypatch):
    plans, stage = {}, line_dedup.stage
    monkeypatch.setattr(
        line_dedup, "stage", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString()) and stage(df, label)
    )
    line_dedup.line_groups(spark.createDataFrame([(1, BASE), (2, BASE + " late")], "metric_id long, construction_notice string")).count()
    assert "text#" not in "".join(line for line in plans["profiled-blocks"].splitlines(True) if "Relation" not in line)


def test_the_test_of_a_pair_of_lines_is_short_enough_to_be_compiled(spark, monkeypatch):
    """Java leaves methods above 8,000 bytes to its interpreter."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before, sizes, stage = {c: spark.conf.get(c) for c in settings}, [], line_dedup.stage
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")

    def measured(df, label):
        if label == "line-pairs":
            sizes.extend(map(int, re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(df._jdf.queryExecution().executedPlan()))))
        return stage(df, label)

    monkeypatch.setattr(line_dedup, "stage", measured)
    try:
        for c, v in settings.items():
            spark.conf.set(c, v)
        line_dedup.line_groups(spark.createDataFrame([(1, BASE), (2, BASE + " late")], "metric_id long, construction_notice string"))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sizes and max(sizes) < 8000


def test_least_edits_are_those_of_the_single_letters(spark):
    rows = [tuple(int(v) for v in RNG.integers(-2**63, 2**63 - 1, 4)) for _ in range(200)] + [(-1, -1, 0, 0), (0, 0, -1, -1), (-1, 0, 0, -1), (5, 5, 5, 5)]
    found = spark.createDataFrame(rows, "a long, b long, c long, d long").select("*", line_dedup._least_edits(["a", "b"], ["c", "d"]).alias("n")).collect()
    letters = lambda *longs: [b for v in longs for b in int(v).to_bytes(8, "little", signed=True)]
    for r in found:
        apart = [p - q for p, q in zip(letters(r.a, r.b), letters(r.c, r.d))]
        assert r.n == max(sum(v for v in apart if v > 0), -sum(v for v in apart if v < 0))


def test_odd_lines_are_found_without_trying_a_pattern_at_each_character(spark):
    lines = ["plain words of one line that is long enough to have a sketch", "x" * 25 + " and words that follow it to make a line", "é" * 24 + " accents of a line that stays as it is",
             "é" * 25 + " accents in a word that is one character too long", "".join(chr(0x4E00 + i) for i in range(60)), "ก" * 20 + " thai word in a line of others that are not"]
    texts = spark.createDataFrame(list(enumerate(lines)), "line_hash long, text string").withColumn("n_chars", F.length("text"))
    plan = line_dedup._sketches(texts)
    assert "[^ ]{25}" not in plan._jdf.queryExecution().optimizedPlan().toString()
    blocks = {r.line_hash: r.blocks for r in plan.collect()}
    for i, line in enumerate(lines):
        odd = re.search(r"[฀-໿က-႟ក-៿぀-ヿ一-鿿]|[^ ]{25}", line)
        parts = [p for w in line.split() for p in (w if len(w) > 24 or re.search(r"[฀-໿一-鿿]", w) else [w])] if odd else line.split()
        hashed = spark.createDataFrame([(p, q) for p, q in zip(parts, parts[1:])], "x string, y string").select(F.xxhash64("x", "y").alias("h"))
        least = hashed.select(F.xxhash64("h", F.lit(0)).alias("m")).agg(
            F.min(F.col("m").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("a"), F.min(F.shiftrightunsigned("m", 32).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("b")
        )
        assert blocks[i][line_dedup.BLOCKS] == least.select(F.xxhash64(F.lit(-1), "a", "b").alias("k")).first().k


def test_lines_that_others_connect_are_not_compared_with_each_other(spark, monkeypatch):
    """Of a chain of lines only the most alike pairs are compared; they connect all of it."""
    words = ["".join(RNG.choice(list("abcdefghijklmnopqrstuvwxyz"), size=6)) for _ in range(120)]
    lines = [" ".join([w[::-1] for w in words[:2 * i]] + words[2 * i:]) for i in range(60)]
    compared, links = [], line_dedup._links
    monkeypatch.setattr(line_dedup, "_links", lambda pairs, *more: compared.append(pairs.count()) or links(pairs, *more))
    group, kept = grouped_lines(spark, lines)
    assert len(set(group)) == 1 and sum(kept) == 1
    assert sum(compared) < 60 * (1 + line_dedup.LIKELY)


def test_bounds_of_edits_decide_as_the_distance_does(spark):
    """Random edits up to both sides of the bound, moved and repeated passages, other scripts, each with and without pieces."""
    rng = np.random.default_rng(13)
    rows = []
    for n in [3, 12, 30, 60, 110, 160, 300] * 6:
        words = [str(w) for w in rng.choice(VOCABULARY if n % 4 else ["ab", "cd"], size=n)]
        other = list(words)
        for _ in range(int(rng.integers(0, max(2, n // 4)))):
            at, kind = int(rng.integers(len(other))), int(rng.integers(4))
            other[at:at + 1] = [[], [other[at], "日本"], [other[at][::-1]], [other[at] + "x"]][kind]
        if n > 100 and rng.integers(3) == 0:
            at, size = int(rng.integers(n - 20)), int(rng.integers(2, 20))
            other[at:at] = words[at:at + size]
        if other:
            rows.append((" ".join(words), " ".join(other)))
    rows += [(" ".join(words[::-1]), " ".join(words)) for words in (prose(80).split(), prose(200).split())]
    pairs = spark.createDataFrame(rows, "ta string, tb string").withColumn(
        "most", F.floor(F.greatest(F.length("ta"), F.length("tb")) / 10).cast("int")
    ).unionByName(spark.createDataFrame([(a, b, 40) for a, b in rows], "ta string, tb string, most int"))
    true = (F.levenshtein("ta", "tb") <= F.col("most")).alias("true")
    found = pairs.select(true, *[line_dedup._within(k).alias(f"w{k}") for k in (128, 512, 1 << 30)]).collect()
    assert {r.true for r in found} == {True, False}
    assert all(r.true == r.w128 == r.w512 == r["w1073741824"] for r in found)


def test_long_similar_lines_are_accepted_without_their_whole_distance(spark):
    words = prose(3000).split()
    other = words[:700] + prose(150).split() + [w + "x" if i % 40 == 0 else w for i, w in enumerate(words[700:])]
    row = spark.createDataFrame([(" ".join(words), " ".join(other))], "ta string, tb string").withColumn("most", F.floor(F.length("tb") / 10).cast("int"))
    assert row.select(F.expr(line_dedup._PIECEWISE)).first()[0] is True


def test_blanks_and_signs_become_single_blanks(spark):
    texts = ["a  b", " a, b ", "a ,b", "a,b", "a , b;; c", "...", " ", "", "\x00a\tb\u00a0c", "A-b  - c.", ", a", "x y z", "é, è  ê"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", line_dedup.normalised(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r.n == re.sub("".join(["[", *[re.escape(chr(c)) for c in range(128) if not chr(c).isalnum()], "]+"]), " ", r.t.lower()).strip(" ")
    assert len(re.findall(line_dedup._SEPARATORS.replace("*+", "*").replace("++", "+"), "one two three")) == 0
