import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cladeflow.llm import closing, minhash, terminality, truncation

HEAD = "commit 1\nAuthor: a <a@b>\nDate:   now\n\n"
HUNK = "diff --git a/x b/x\nindex 1..2\n--- a/x\n+++ b/x\n@@ -1,3 +1,3 @@\n one\n-two\n+three\n four\n"
MAIL = "From 1\nFrom: a\nDate: now\nSubject: [PATCH] fix it\n\nBody.\n"


@pytest.mark.parametrize(
    ("text", "state"),
    [
        (None, None),
        ("", None),
        (" \n\t", None),
        (HEAD + "    Fix it\n", "done"),
        (HEAD + "    Fix it\n\n" + HUNK, "done"),
        (HEAD + "    Fix it\n\n" + HUNK.rstrip("\n"), "done"),
        (HEAD + "    Fix it\n\n" + HUNK + "\\ No newline at end of file\n", "done"),
        (HEAD + "    Fix it\n\n" + HUNK[:-8], "open"),
        (HEAD + "    Fix it\n\n" + HUNK[: HUNK.index("+three")], "open"),
        (HEAD + "    Fix it\n\n" + HUNK[: HUNK.index(" one")], "open"),
        (HEAD + "    Fix it\n\n" + HUNK[: HUNK.index("@@")], "open"),
        (HEAD + "    Fix it\n\n" + HUNK + "diff --git a/y b/y\nindex 1..2 100644\nBinary files a/y and b/y differ", "done"),
        (HEAD + "    Fix it\n\n" + HUNK + "diff --git a/y b/y\nindex 1..2 100644\nBinary files a/y and b/", "open"),
        (HEAD + "    Fix it\n\ndiff --git a/y b/z\nsimilarity index 100%\nrename from y\nrename to z\n", "done"),
        (HEAD + "    Fix it\n\ndiff --git a/y b/y\nGIT binary patch\nliteral 3\nKc$@*abcde12345A\n", "done"),
        (HEAD + "    Fix it\n\ndiff --git a/y b/y\nGIT binary patch\nliteral 300\nz" + "a" * 65, "open"),
        (HEAD + "    Fix it\n\ndiff --git a/y b/y\nGIT binary patch\nliteral 300\nz" + "a" * 65 + "\nKab", "open"),
        ("commit 1\nAuth", "open"),
        (HEAD + "    Fix i", "word"),
        ("r12 | a | now\n\nFix", "word"),
        (MAIL + "-- \n2.30.1\n", "done"),
        (MAIL + "-- \n2.30.1", "done"),
        (MAIL, "unsigned"),
        (MAIL + HUNK[:-9], "open"),
    ],
)
def test_how_records_close(text, state):
    close = closing.close_of(text)
    assert (close.state if close else None) == state


def test_marks_stand_for_the_rest():
    for mark in ("…", "...", " [...]", " (cut)"):
        c = closing.close_of(HEAD + "    Replace the hid" + mark)
        assert c.state == "word" and c.token == "hid"


def test_closing_words_and_their_kind_of_line():
    assert terminality.close_of("a b\nSubject: fix it") == ("Subject:", "it")
    assert terminality.close_of("a\n\n+x = 12") == ("^+", "99")
    assert terminality.close_of("Fix hid (cut)") == ("a", "hid")
    assert terminality.close_of("Fix it\n") is None and terminality.close_of("Fix\r\n+ x\r") is None
    assert terminality.close_of("a\n   ") == ("", None) == terminality.close_of("a\n…")
    assert terminality.normal("zAb1Cd2Ef3Gh").startswith(terminality.OPAQUE) and terminality.normal("0a78550d") == "h" * 8


def test_token_counts_against_a_walk_over_the_lines():
    docs, _ = corpus()
    texts = [*docs.values(), "", " \n", None, "one line", "x: y\n\nz\n"]
    want = Counter()
    for t in texts:
        before = None
        for line in (t or "").split("\n")[:-1]:
            words = line.split()
            for i, w in enumerate(words):
                key = (terminality.kind_of(line, words[0], before is not None and not before.strip()), terminality.normal(w))
                want[(key, "seen")] += 1
                want[(key, "closing")] += i == len(words) - 1
            before = line
    got = Counter()
    for kind, token, seen, closing_ in terminality.count_tokens(minhash.split(pa.array(texts))):
        got[((kind, token), "seen")] += seen
        got[((kind, token), "closing")] += closing_
    assert +got == +want


def grams_of(texts):
    words = minhash.split(pa.array(texts, pa.string()))
    return minhash.shingle_hashes(words.hashes(), words.by_text)


def test_bands_of_growing_beginnings():
    r = random.Random(4)
    base = [f"w{r.randrange(5000)}" for _ in range(400)]
    other = [f"w{r.randrange(5000)}" for _ in range(400)]
    texts = [" ".join(base), " ".join(base[:120]), " ".join(base[:60] + other[:60]), " ".join(other), "", None, "one two", " ".join(base[:6])]
    keys, at = minhash.band_keys(*grams_of(texts))
    widths = np.diff(at) // minhash.BANDS
    lengths = [len((t or "").split()) for t in texts]
    assert widths.tolist() == [sum(w <= n for w in minhash.WIDTHS) for n in lengths]
    of = [keys[a:b].reshape(-1, minhash.BANDS) for a, b in zip(at[:-1], at[1:])]
    assert (of[1] == of[0][: len(of[1])]).all()  # what is left of a text has its whole's bands
    assert (of[2][-1] != of[0][len(of[2]) - 1]).any() and not set(of[3].ravel()) & set(of[0].ravel())
    alone, _ = minhash.band_keys(*grams_of([texts[1]]))
    assert (alone == of[1].ravel()).all()  # independent of the batch


def test_anchors_of_equal_stretches():
    r = random.Random(7)
    shared = [f"s{r.randrange(10**6)}" for _ in range(minhash.ANCHORS + minhash.WORDS - 1)]
    texts = [" ".join([f"a{k}" for k in range(n)] + shared + tail) for n, tail in ((3, []), (90, ["x", "y"]), (41, ["z"] * 30))]
    grams, off = grams_of(texts)
    picked = set(minhash.anchors(grams, off).tolist())
    stop = [int(off[0]) + 3 + minhash.ANCHORS, int(off[1]) + 90 + minhash.ANCHORS, int(off[2]) + 41 + minhash.ANCHORS]
    places = [minhash.anchor_before(grams, int(off[i]), e) for i, e in enumerate(stop)]
    assert len({int(grams[p]) for p in places}) == 1 and set(places) <= picked
    for n in range(1, 12):  # short texts: the beginning of a longer one has its anchor there
        g, o = grams_of([" ".join(shared), " ".join(shared[: n + minhash.WORDS - 1])])
        p = minhash.anchor_before(g, int(o[1]), int(o[2]))
        assert p - int(o[1]) in minhash.anchors(g, o)


def corpus():
    """Complete records, and cut ones with their number."""
    r = random.Random(6)
    nouns, adjectives, verbs = ["parser", "buffer", "queue", "index"], ["stale", "hidden", "slow"], ["Fix", "Replace", "Drop"]
    docs, cut = {}, set()
    for i in range(400):
        body = "".join(f"    This keeps the {r.choice(adjectives)} {r.choice(nouns)} with the {r.choice(adjectives)} {r.choice(nouns)}.\n" for _ in range(r.randrange(1, 5)))
        lines = "".join(f"+value{r.randrange(10**6)} = other{r.randrange(10**6)}(arg{r.randrange(99)})\n" for _ in range(20))
        full = f"commit {i}\nAuthor: a{i} <a@b>\nDate:   d{i}\n\n    {r.choice(verbs)} {r.choice(adjectives)} {r.choice(nouns)}\n\n{body}"
        if i % 2:
            full += f"\ndiff --git a/f{i} b/f{i}\n--- a/f{i}\n+++ b/f{i}\n@@ -0,0 +1,20 @@\n{lines}"
        docs[i] = full.rstrip("\n") if i % 5 == 0 else full
    for i in range(0, 60):
        text = docs[i].rstrip("\n")
        if i % 2:
            stop = text.index("@@ -0") + 60
        else:
            stop = text.rindex("with the ") + 12
        docs[1000 + i] = text[:stop]
        cut.add(1000 + i)
    return docs, cut


def test_judging_a_corpus(spark):
    docs, cut = corpus()
    docs |= {2000: None, 2001: " \n", 2002: docs[1], 2003: docs[1001], 2004: docs[3] + "@@ -50,1 +50,1 @@\n-a\n+b\n", 3000: HEAD + "    Drop stale par"}
    cut |= {2003, 3000}
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, token string")
    rows = truncation.judge(df).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == len(docs) - 2
    assert {r["doc_id"] for r in rows if r["cut"]} == cut
    by = {r["doc_id"]: r for r in rows}
    assert by[2002]["class_id"] == 1 and by[2003]["class_id"] == 1001 and by[2003]["by"] == by[1001]["by"]
    assert by[3000]["by"] == "word" and "alignment" in {r["by"] for r in rows}


def pairs_of(df):
    """(pairs, texts in buckets)."""
    scanned = truncation.scan(df)
    members = truncation.buckets(scanned, truncation.classes(scanned).where("doc_id = class_id").select("doc_id"))
    texts = truncation.texts_of(df, members)
    return truncation.candidate_pairs(members, texts), texts


@pytest.mark.parametrize("share", [0.2, 0.3, 0.5, 0.8])
def test_planted_cut_copies_meet_their_whole(spark, share):
    """Against exact containment: a copy with a few words changed, cut at a share of its whole, among others that begin alike."""
    r = random.Random(int(share * 10))
    docs = {}
    for i in range(120):
        words = [f"w{r.randrange(20_000)}" for _ in range(r.randrange(120, 400))]
        docs[i] = " ".join([f"head{i % 7}", "of", "many", "texts"] + words)
        copy = docs[i].split()[: int(len(docs[i].split()) * share)]
        for k in range(len(copy) // 60):  # a changed word breaks five shingles
            copy[r.randrange(len(copy) - 16)] = f"new{i}x{k}"
        docs[1000 + i] = " ".join(copy)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    pairs, texts = pairs_of(df)
    found = {tuple(x) for x in pairs.collect()}
    grams = {i: set(zip(*[t.split()[k:] for k in range(minhash.WORDS)])) for i, t in docs.items()}
    contained = {(s, l) for s in docs for l in docs if s >= 1000 > l and len(grams[s] & grams[l]) >= truncation.CONTAINED * len(grams[s])}
    assert len(contained) > 100 and len(found & contained) >= 0.9 * len(contained)
    by = {x["doc_id"]: x["by"] for x in truncation.judge(df).collect()}
    assert sum(by[s] == "alignment" for s, _ in contained) >= 0.9 * len(contained)
    assert not any(by[i] == "alignment" for i in docs if i < 1000)


def test_the_longest_of_a_bucket_hides_no_other_pair(spark):
    """All begin alike, the longest unrelated otherwise: cut between words, inside the last word, and with a mark."""
    r = random.Random(8)
    same = " ".join(f"same{k}" for k in range(300))
    texts = {k: [f"w{r.randrange(10**6)}" for _ in range(n)] for k, n in ((1, 300), (2, 120), (3, 100), (4, 80))}
    docs = {k: HEAD + same + " " + " ".join(w) for k, w in texts.items()}
    docs |= {12: " ".join(docs[2].split(" ")[:-30]), 13: docs[3][:-2], 14: " ".join(docs[4].split(" ")[:-20]) + " [...]"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    pairs, texts = pairs_of(df)
    assert {(12, 2), (13, 3), (14, 4)} <= {tuple(x) for x in pairs.collect()}
    assert {x["doc_id"]: x["inside"] for x in truncation.aligned_early(texts, pairs).collect()} == {12: False, 13: True, 14: False}


def test_a_hot_bucket_makes_one_pair_a_text_and_band(spark):
    docs = [(i, HEAD + " ".join(f"same{k}" for k in range(60)) + f" end{i} of this text") for i in range(400)]
    pairs, _ = pairs_of(spark.createDataFrame(docs, "doc_id long, text string"))
    assert pairs.count() <= 400 * minhash.BANDS


def family(r):
    """Texts that begin alike: a whole (1), a copy of it cut between words (2) and three longer ones that hold the copy's end, but not what is before."""
    same, own = [f"same{k}" for k in range(100)], [f"own{k}" for k in range(120)]
    docs = {1: same + own, 2: same + own[:60]}
    docs |= {10 + i: same + [f"w{r.randrange(10**6)}" for _ in range(200 + 10 * i)] + own[46:60] + [f"t{i}x{k}" for k in range(80)] for i in range(3)}
    return {k: HEAD + " ".join(w) for k, w in docs.items()}


def test_longer_texts_with_the_same_end_hide_no_partner(spark):
    docs = family(random.Random(9))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert truncation.ends_early(docs[2], docs[1]) and not any(truncation.ends_early(docs[2], docs[10 + i]) for i in range(3))
    assert {(2, 1), (2, 10), (2, 11), (2, 12)} <= {tuple(x) for x in pairs_of(df)[0].collect()}
    assert {x["doc_id"] for x in truncation.judge(df).collect() if x["by"] == "alignment"} == {2}


def test_a_partner_far_behind_and_one_changed_near_the_end_are_kept(spark):
    """The whole with 500 words put in, and copies with one word changed 7 to 12 words before their end."""
    r = random.Random(10)
    docs, want = {}, set()
    for i in range(8):
        words = [f"i{i}w{r.randrange(10**6)}" for _ in range(200)]
        docs[i], copy = " ".join(words), words[:150]
        if i < 6:
            copy[-7 - i] = "changed"
        else:
            docs[i] = " ".join(words[:110] + [f"in{i}x{k}" for k in range(500)] + words[110:])
        docs[100 + i] = " ".join(copy)
        want.add((100 + i, i))
    assert all(truncation.ends_early(docs[a], docs[b]) for a, b in want)
    pairs, _ = pairs_of(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert want <= {tuple(x) for x in pairs.collect()}


def test_pairs_against_all_of_a_bucket(spark):
    """Every pair of one bucket that aligns is among the candidates, and trying the longest first finds the same texts as all pairs do,
    or, of complete ones, the same that stop inside a word."""
    r = random.Random(11)
    same, docs = [f"same{k}" for k in range(100)], {}
    for i in range(12):
        docs[i] = HEAD + " ".join(same + [f"w{r.randrange(40)}" for _ in range(r.randrange(5, 60))] + ["the", "end", "of", "all", "the", "texts"][: r.randrange(7)])
        docs[100 + i] = docs[i][: -r.randrange(1, 40)]
        docs[200 + i] = docs[i][: -r.randrange(1, 40)] + r.choice([" [...]", "…", " (cut)"])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = {(a, b): truncation._early(*truncation._shingles([docs[a], docs[b]]), docs[a], docs[b]) for a in docs for b in docs if len(docs[a]) < len(docs[b])}
    want = {k: v for k, v in want.items() if v}
    pairs, texts = pairs_of(df)
    assert {"between", "inside"} == set(want.values()) and set(want) <= {tuple(x) for x in pairs.collect()}
    scanned = truncation.scan(df)
    members = truncation.buckets(scanned, truncation.classes(scanned).where("doc_id = class_id").select("doc_id"))
    every = {a: any(v == "inside" for (x, _), v in want.items() if x == a) for a, _ in want}
    for done in ([], sorted(docs)):
        found = {x["doc_id"]: x["inside"] for x in truncation.near_copies(members, texts, spark.createDataFrame([(i,) for i in done], "doc_id long")).collect()}
        assert found == {k: True for k, v in every.items() if v} if done else set(found) == set(every)


def test_many_copies_meet_the_longest_alone(spark, monkeypatch):
    words = [f"w{k}" for k in range(180)]
    docs = [(i, " ".join(words[: 110 + i])) for i in range(60)]
    verify, asked = truncation.aligned_early, []
    monkeypatch.setattr(truncation, "aligned_early", lambda texts, pairs: asked.append(pairs.count()) or verify(texts, pairs))
    by = {x["doc_id"]: x["by"] for x in truncation.judge(spark.createDataFrame(docs, "doc_id long, text string"), check=None).collect()}
    assert sum(v == "alignment" for v in by.values()) >= 58 and sum(asked) <= 3 * len(docs)


def test_complete_texts_of_a_hot_bucket_meet_none_that_only_go_on(spark, monkeypatch):
    """Half close with a sentence that stands in the middle of the others; one of them is cut inside a word that one other text alone has there."""
    r = random.Random(12)
    docs = {}
    for i in range(80):
        words = [f"same{k}" for k in range(100)] + [f"w{r.randrange(10**6)}" for _ in range(20)] + ["the", "last", "sentence", "of", "all"]
        docs[i] = HEAD + " ".join(words) + (" texts\n" if i % 2 else f" texts {' '.join(f'more{i}x{k}' for k in range(30))}\n")
    docs[100] = HEAD + " ".join(docs[4][len(HEAD) :].split()[:125]) + " tex"
    docs[4] = docs[4].replace("texts", "texture")
    verify, asked = truncation.aligned_early, []
    monkeypatch.setattr(truncation, "aligned_early", lambda texts, pairs: asked.append(pairs.count()) or verify(texts, pairs))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    by = {x["doc_id"]: x["by"] for x in truncation.judge(df, check=lambda t: "done").collect()}
    assert {i for i, v in by.items() if v == "alignment"} == {100} and sum(asked) <= len(docs)


def test_last_shingles_are_those_that_alignment_asks_for(spark):
    texts = ["a b c d e f g h", "a b c d e f [...]", "a b c d e f…", "a b c d e", "a b c d e f", "  a b\n\nc d e f g (cut)", "a b c d e f g\n", "", " \n", None, "…", "a b c d e f \x1c g\x85h\u2028i"]
    rows = truncation._last_shingles([pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])])
    got = [x["gram"] for b in rows for x in b.to_pylist()]
    for t, g in zip(texts, got):
        grams = truncation._shingles([t or ""])[0]
        own = grams[: max(0, truncation._complete_words(t or "", len(grams) + minhash.WORDS - 1) - minhash.WORDS + 1)]
        assert g == (int(own.view(np.int64)[-1]) if len(own) else None)


def test_field_limits_by_source(spark):
    r = random.Random(3)
    rows = [(i, "a", r.randrange(100, 3000)) for i in range(2000)] + [(5000 + i, "a", 1500) for i in range(20)] + [(9000 + i, "b", 1500) for i in range(3)]
    rows += [(20_000 + i, "c", 200 + i % 5) for i in range(2000)]  # many of a length, as their neighbours are
    members = spark.createDataFrame([(i, s, n) for i, s, n in rows], "class_id long, source string, size long")
    found = {x["class_id"] for x in truncation.limited(members).collect()}
    assert set(range(5000, 5020)) <= found and all(dict((i, n) for i, _, n in rows)[i] == 1500 for i in found) and not found & set(range(9000, 9003))
    assert truncation.limited(members.limit(0)).count() == 0


def test_beginnings_of_words(spark):
    words = ["index", "indexed", "in", "x" * 200_000, "Überblick", "a", "abc", "\x00z9"]
    asked = ["ind", "index", "indexed", "x" * 150_000, "x" * 200_000, "Üb", "Ü", "b", "ab", "abc", "zz", "\x00z", None]
    w, a = (spark.createDataFrame([(x,) for x in v], "token string") for v in (words, asked))
    want = {t for t in asked if t and not t.startswith("\x00") and any(x != t and x.startswith(t) for x in words if not x.startswith("\x00"))}
    assert {r["token"] for r in truncation.begun_words(a, w).collect()} == want


def test_without_an_exact_check(spark):
    docs, cut = corpus()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = truncation.judge(df, check=None).collect()
    found = {r["doc_id"] for r in rows if r["cut"]}
    assert len(found & cut) >= 0.9 * len(cut) and len(found & cut) >= 0.9 * len(found)


def test_a_copy_cut_inside_the_last_word(spark):
    text = HEAD + "    " + " ".join(f"word{i}" for i in range(100))
    df = spark.createDataFrame([(1, text + "\n"), (2, text[:-1])], "doc_id long, text string")
    assert {x["doc_id"]: x["by"] for x in truncation.judge(df).collect()} == {1: None, 2: "alignment"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert truncation.judge(df).count() == 0


def test_very_long_text(spark):
    text = HEAD + "    Fix it\n\n" + "diff --git a/x b/x\n@@ -0,0 +1,200000 @@\n" + "+x y z\n" * 200_000
    df = spark.createDataFrame([(1, text), (2, text[:-9])], "doc_id long, text string")
    assert {r["doc_id"]: r["cut"] for r in truncation.judge(df).collect()} == {1: False, 2: True}
