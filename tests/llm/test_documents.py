"""Operators on whole documents, each against a plain version on small tables."""

import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

from sparkloom.llm import byte_bpe, fingerprints, line_dedup, lm_score, packing, quality, similar, simhash, toxicity, unigram
from sparkloom.llm.boosting import Boosted, isotonic

BLANKS = "[\\x20\\x09-\\x0D]+"


def words_of(text):
    return [w for w in re.split(BLANKS, text or "") if w]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- quality rules ---------------------------------------------------------------------------------------


def plain_counts(text):
    t = text or ""
    words = words_of(t)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    full = [x for x in t.split("\n") if words_of(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(covered)


def test_quality_counts_match_plain(docs):
    got = quality.query(docs)
    for r in got.join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        want = plain_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert got.count() == docs.count()


def test_quality_rules_by_line(spark):
    good = "A sentence of some length stands here and says what it says in twenty plain words or a few more of them."
    cases = {
        "nav": ("Home | News | Sport | More\n" + good, good),
        "noise": ("a### b*** c$$$ d%%%\n" + good, good),
        "shout": ("BUY!! NOW!! CHEAP!!\n" + good, good),
        "notice": ("Licensed under the MIT License.\n" + good, good),
        "fragment": ("Menu\n" + good, good),
        "plain": (good + "\n\nAnother line.", good + "\n\nAnother line."),
        "repeats": ("again " * 60, None),
        "lost": ("\n".join("x | y | z | q" for _ in range(20)) + "\n" + good, None),
        "short": ("Just five words stand here.", None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in enumerate(cases.values())], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in quality.clean(df).collect()}
    for k, (name, (_, want)) in enumerate(cases.items()):
        assert kept.get(k) == want, name


def test_quality_filter_on_verdict_plans_quickly(docs):
    assert quality.query(docs).filter("kept").count() == quality.clean(docs).count()


# --- line dedup ------------------------------------------------------------------------------------------


def plain_dedup(rows, min_words=8):
    """Every window of every length, line by line longer, the smallest place first: (doc_id, text) -> cleaned text."""
    lines = {}
    for doc, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        lines[doc, text] = [(i, x, len(words_of(x))) for i, x in enumerate(text.split("\n")) if words_of(x)]
    dead, width = {k: set() for k in lines}, 0
    classes = {(k, i): 0 for k, row in lines.items() for i in range(len(row))}  # of the windows that begin there
    while classes:
        width += 1
        names, counts = {}, Counter()
        longer = {}
        for (k, i), c in classes.items():
            if i + width <= len(lines[k]):
                name = names.setdefault((c, lines[k][i + width - 1][1]), len(names))
                counts[name] += 1
                longer[k, i] = name
                window = lines[k][i : i + width] if counts[name] > 1 else []
                if sum(w for _, _, w in window) >= min_words:
                    dead[k].update(n for n, _, _ in window)
        classes = {x: c for x, c in longer.items() if counts[c] > 1}
    return {k: "\n".join(x for i, x in enumerate(k[1].split("\n")) if i not in dead[k]) for k in lines}


def test_line_dedup_counts_words_by_run(spark):
    """Three repeated lines of three words are nine words; runs that end in short lines; runs from two places."""
    r = random.Random(5)
    rows = [(1, "a b c\nd e f\ng h i\nnew"), (2, "other\na b c\nd e f\ng h i\nend"), (3, "a b c\nd e f"), (4, "d e f\ng h i\na b c")]
    rows += [(5, "one two three four five six seven eight nine\nshort line"), (6, "x\none two three four five six seven eight nine\nshort line\ny")]
    rows += [(10 + k, "\n".join(" ".join("uvw"[r.randrange(3)] for _ in range(r.randint(0, 4))) for _ in range(r.randint(1, 14)))) for k in range(60)]
    want = plain_dedup(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["doc_id"], x["text"]): x["clean_text"] for x in line_dedup.dedup(df).collect()}
    assert got == want
    assert got[rows[1]] == "other\nend" and got[rows[3]] == rows[3][1] and got[rows[5]] == "x\ny"
    assert [x["clean_text"] for x in line_dedup.dedup(df.limit(0)).collect()] == []
    got = {(x["doc_id"], x["text"]): x["clean_text"] for x in line_dedup.dedup(df, min_words=3).collect()}
    assert got == plain_dedup(rows, 3)


def test_line_dedup_matches_plain(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain_dedup(rows)
    got = line_dedup.dedup(docs)
    assert got.count() == len(rows)
    for r in got.collect():
        assert r["clean_text"] == (want[r["doc_id"], r["text"]] if r["text"] is not None else None)


def test_line_dedup_runs(spark):
    a, b, c = ("line number %s holds some words for a start" % x for x in ("one", "two", "three"))
    rows = [(1, f"{a}\n{b}\nx y z."), (2, f"new\n{a}\n\n{b}\nend"), (3, f"{c}\n{c}\n{c}"), (4, "short\nshort\nother"), (5, f"{b}\n{a}")]
    got = {r["doc_id"]: r["clean_text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "new\n\nend", 3: c, 4: rows[3][1], 5: ""}
    kept = line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4}


def test_suffix_array_order_and_prefixes(spark):
    rows = [(1, "a a\nb b\nc c"), (2, "b b\nc c\na a"), (3, "a a\nb b\nc c\nzz")]
    got = line_dedup.suffix_array(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["levels"] for r in got] == sorted(r["levels"] for r in got)
    by = {(r["doc"], r["at"]): r["levels"] for r in got}
    assert by[1, 0][:2] == by[3, 0][:2] and by[1, 1][:2] == by[2, 0][:2] == by[3, 1][:2]
    assert len(by[1, 2]) == 1 and (3, 3) not in by


# --- simhash ---------------------------------------------------------------------------------------------


def plain_fingerprint(text, size=3):
    words = [w.encode() for w in words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_plain_and_spark(spark, texts):
    for t in texts[:50]:
        if len(t or "") < 5000:
            assert fingerprints.fingerprint(t) == plain_fingerprint(t)
    one = spark.sql("select xxhash64('a b c') h").first()["h"] % (1 << 64)
    assert fingerprints.fingerprint("A b\tc") == one


def plain_components(pairs):
    ids = {d: f for d, f in pairs if d is not None}
    parent = {d: d for d in ids}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    order = sorted(ids)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (ids[a] ^ ids[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in order}


@pytest.mark.parametrize("limit", [1024, 4])
def test_simhash_components_match_plain(docs, limit):
    got = simhash.components(docs, limit=limit).collect()
    assert len(got) == docs.count()
    want = plain_components([(r["doc_id"], r["fp"] % (1 << 64)) for r in got])
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]]


def test_simhash_links_random_neighbours(spark):
    """Chains of fingerprints 1 to 4 bits apart, with small buckets, so that levels of splitting are used."""
    r = np.random.default_rng(3)
    found = [int(x) for x in r.integers(0, 1 << 63, 40, dtype=np.uint64)]
    for k in range(300):
        x = found[k % len(found)]
        for b in r.choice(64, r.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        found.append(x)
    found = sorted(set(found))
    signed = [(k, simhash._signed(x)) for k, x in enumerate(found)]
    for limit in (1024, 8):
        links = simhash.links(spark.createDataFrame(signed, "node long, fp long"), 3, limit).collect()
        parent = list(range(len(found)))

        def find(a):
            while parent[a] != a:
                a = parent[a]
            return a

        for a, b in links:
            assert a != b
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        want = plain_components(list(enumerate(found)))
        assert {k: find(k) for k in range(len(found))} == want


def kept_by_text(spark, texts, **how):
    """Ids that keep_first keeps of {id: text}."""
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return sorted(r["doc_id"] for r in simhash.keep_first(df, **how).collect())


def test_simhash_query_and_keep_first(docs, texts):
    from tests_llm_plain import plain_groups

    got = simhash.query(docs)
    assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in got.collect())
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    groups = plain_groups(dict(enumerate(texts)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups.values()))


def test_keep_first_tells_texts_from_ids(spark, make_prose):
    a, b, c = (make_prose(k, 80, 3000) for k in (1, 2, 3))
    rows = [(2, a), (5, a), (5, b), (9, c), (9, c), (None, c), (None, a + " more"), (None, make_prose(4, 80, 3000))]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([(2, a), (5, b), (9, c), rows[-1]], key=str)


def test_simhash_links_over_rows_without_id(spark, monkeypatch):
    """A fingerprint that only rows without an id hold bridges two others."""
    prints = spark.createDataFrame([(5, 0), (None, 7), (3, 63), (None, -1)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "with_fingerprint", lambda *_: prints)
    got = {tuple(r) for r in simhash.components(prints).collect()}
    assert got == {(5, 0, 3), (None, 7, 3), (3, 63, 3), (None, -1, None)}


@pytest.mark.parametrize(("changes", "block"), [(2, 128), (3, 128), (3, 16), (6, 128)])
def test_similar_texts_of_one_template(spark, monkeypatch, changes, block):
    """240 texts of one template: dense and sparse links alike equal those of all pairs."""
    r = random.Random(changes)
    monkeypatch.setattr(similar, "BLOCK", block)
    base = [f"w{r.randrange(5000)}" for _ in range(160)]
    texts = {}
    for k in range(240):
        words = list(base)
        for at in r.sample(range(160), changes):
            words[at] = f"e{k}x{at}"
        texts[k] = " ".join(words)
    sets = [{tuple(t.split(" ")[i : i + 5]) for i in range(156)} for t in texts.values()]
    parent = list(range(240))
    for i in range(240):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
                parent = [new if p == old else p for p in parent]
    got = similar.links(spark.createDataFrame(list(texts.items()), "node long, text string")).collect()
    found = list(range(240))
    for i, j in got:
        assert len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
        old, new = max(found[i], found[j]), min(found[i], found[j])
        found = [new if p == old else p for p in found]
    assert found == parent


def test_similar_sets_share_a_bucket():
    """No pair of similar sets misses: sizes from 1 to 400, from equal to just similar enough."""
    r = np.random.default_rng(3)
    for size in [*range(1, 60), 100, 250, 400]:
        for _ in range(6):
            both = r.integers(0, 2**63, size, dtype=np.uint64)
            room = int(size / 0.8 + 1e-9) - size
            left = int(r.integers(0, room + 1))
            a, z = (np.unique(np.append(both, r.integers(0, 2**63, n, dtype=np.uint64))) for n in (left, room - left))
            assert len(np.intersect1d(a, z)) >= 0.8 * len(np.union1d(a, z))
            assert set(similar.signatures(a, 0.8)[0].tolist()) & set(similar.signatures(z, 0.8)[0].tolist())
            # Whatever buckets hold the most texts: without those that each can spare, one is still shared.
            for _ in range(5):
                salt = np.uint64(r.integers(1, 2**63))
                kept = []
                for h in (a, z):
                    sigs, classes = similar.signatures(h, 0.8)
                    starts = np.cumsum([0, *[n for _, n, _ in classes]])
                    parts = [sorted(sigs[lo : lo + n].tolist(), key=lambda x: int(similar.mixed(np.array([x]).view(np.uint64) ^ salt)[0])) for lo, (_, n, _) in zip(starts, classes, strict=False)]
                    kept.append({x for p, (_, _, spare) in zip(parts, classes, strict=True) for x in p[spare:]})
                assert kept[0] & kept[1]


def test_similar_texts_meet(spark, make_prose):
    """Copies with one word in forty changed, hot shared passages, and unrelated texts, against all pairs."""
    from tests_llm_plain import plain_groups

    r = np.random.default_rng(4)
    texts, passage = {}, make_prose(900, 60)
    for k in range(12):
        base = make_prose(1000 + k, 150, 3000).split(" ")
        for j in range(6):
            words = list(base)
            for i in r.choice(len(words), j, replace=False):
                words[i] = f"edit{k}x{j}x{i}"
            texts[k * 10 + j] = " ".join(words)
    texts |= {500 + k: passage + " " + make_prose(2000 + k, 150, 3000) for k in range(40)}
    texts |= {600 + k: make_prose(3000 + k, 12) for k in range(20)} | {700: "", 701: None, 702: "one"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    groups = {}
    for x in simhash.text_groups(df).collect():
        groups.setdefault(x["part"], set()).add(x["doc_id"])
    want = {}
    for k, v in plain_groups(texts).items():
        want.setdefault(v, set()).add(k)
    assert len(want) < 110 < len(texts)
    assert sorted(map(min, groups.values())) == sorted(want) and sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert kept_by_text(spark, texts) == sorted(want)


# --- packing ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("capacity", "least"), [(2048, 64), (64, 64), (256, 1)])
def test_packing_keeps_every_id_once(docs, capacity, least):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(byte_bpe.default_path())
    pieces = packing.pack(docs, capacity=capacity, min_piece=least).collect()
    ids = {r["doc_id"]: np.array(coder.encode(r["text"] or "", add_special_tokens=False).ids + [1], dtype="<u4") for r in docs.filter("doc_id is not null").collect()}
    sequences, documents = {}, {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        if p["doc_id"] is not None:
            part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
            assert p["doc_tokens"] == len(ids[p["doc_id"]]) and p["ids_crc32"] == zlib.crc32(part.tobytes())
            documents.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
    for doc, found in documents.items():
        copies = sum(n for _, n in found) // len(ids[doc])
        places = np.zeros(len(ids[doc]), dtype=int)
        for start, n in found:
            places[start : start + n] += 1
        assert (places == copies).all()
    padding = 0
    for found in sequences.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert sum(len(x) for x in documents.values()) >= len(documents)
    if least < capacity:
        assert padding < 0.02 * sum(p["length"] for p in pieces)


def test_packing_classes():
    """Every sequence of class k has k pieces of a k-th; tails go by their own class; with min_piece = capacity no remainder is cut."""
    packer = packing.Packer(2048, 46, 0)
    rows = [r for d in range(700) for r in packer.add(d, np.arange(d * 13 % 4000 + 1, dtype="<u4"))]
    sizes = {}
    for _, _, n, _, _, sequence, _ in rows:
        sizes.setdefault(sequence, []).append(n)
    for found in sizes.values():
        k = len(found)
        assert sum(found) == 2048 and max(found) - min(found) <= 1 or all(2048 // n == k for n in found)
    assert {1, 2, 3, 5, 6, 7, 11} <= {len(x) for x in sizes.values()}
    plain = packing.Packer(2048, 2048, 0)
    assert list(plain.add(1, np.arange(700))) == [] and [r[2] for r in plain.add(2, np.arange(690))] == [700, 690]


@pytest.mark.parametrize("blank", [" ", "\n", " \t\n", "\u3000\u00a0 "])
def test_byte_bpe_long_whitespace(blank):
    from tokenizers import Tokenizer

    coder, path = Tokenizer.from_file(byte_bpe.default_path()), byte_bpe.default_path()
    for size, texts in ((1_000_000, ["{}", "a{}b"]), (2_000_000, ["{}word", "x <|endoftext|>{}<|endoftext|>y"]), (5_000_000, ["end.{}"] if blank in " \n" else [])):
        run = blank * (size // len(blank))
        for t in texts:
            t = t.format(run)
            assert byte_bpe.ids(path, t).tolist() == coder.encode(t, add_special_tokens=False).ids
    for n in (byte_bpe.RUN - 1, byte_bpe.RUN, byte_bpe.RUN + 1):
        for t in (f"a{blank * n}b c", f"{blank * n}'s{blank * n}1", f"!{blank * n}"):
            assert byte_bpe.ids(path, t).tolist() == coder.encode(t, add_special_tokens=False).ids


def test_packing_long_whitespace(spark):
    rows = [(1, "a" + " " * 1_200_000 + "b"), (2, "\n" * 1_000_000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1_200_002, 1_200_002), (2, 500_001, 500_001)]


def test_byte_bpe_equals_the_library():
    from tokenizers import Tokenizer

    coder, path = Tokenizer.from_file(byte_bpe.default_path()), byte_bpe.default_path()
    odd = ["", " ", "a <|endoftext|> b", "é́ x퟿　y", "  x  \n\n y\t", "don't I'LL", "１２३ ٣", "a b c", "😀👍🏽 ß ẞ", "\x00\x1f", "ab" * 3000]
    r = np.random.default_rng(1)
    odd += ["".join(chr(c) for c in r.choice([*range(32, 300), 0x2028, 0x85, 0x4E2D, 0x1F600, 0x5D0, 9, 10, 13], 40)) for _ in range(300)]
    for t in odd:
        assert byte_bpe.ids(path, t).tolist() == coder.encode(t, add_special_tokens=False).ids, repr(t)


def test_byte_bpe_long_text_in_parts(monkeypatch, texts):
    path, long = byte_bpe.default_path(), texts[47]
    whole = byte_bpe.ids(path, long).tolist()
    monkeypatch.setattr(byte_bpe, "CHUNK", 500)
    assert byte_bpe.ids(path, long).tolist() == whole
    assert byte_bpe.ids(path, "x" * 2000 + "  " * 400).tolist() == byte_bpe.encoder(path)("x" * 2000 + "  " * 400)


# --- unigram ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.load(unigram.default_path())


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer, models

    scored = [(p, float(vocabulary.scored[p][0]) if p in vocabulary.scored else 0.0) for p, _, _ in vocabulary.pieces]
    coder = Tokenizer(models.Unigram(scored, unk_id=vocabulary.unknown, byte_fallback=True))
    return lambda t: coder.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids if t else []


def test_unigram_matches_the_library(vocabulary, library, texts):
    counter, codec = unigram.TokenCounter(vocabulary), unigram.Codec(vocabulary)
    r = np.random.default_rng(2)
    cases = [t or "" for t in texts] + ["  two  blanks ", "▁x ▁", "ṿ 𝔘\nß\t日本", "a" * 500, " "]
    cases += ["".join(r.choice(list("abc ▁éñ日\t😀  \n.,<0x0A>"), 25)) for _ in range(300)]
    for t in cases:
        want, got = library(t), codec.encode(t)
        assert got.tolist() == want
        score, n = counter.count(t)
        assert n == len(want)
        assert codec.decode(got) == t.replace("▁", " ")
        if t:
            known = [vocabulary.scored[p][0] for p in (vocabulary.pieces[i][0] for i in want) if p in vocabulary.scored]
            if len(known) == len(want):
                assert score == pytest.approx(sum(known))


def test_unigram_ties_take_the_longest_last_piece():
    pieces = [("<unk>", 0.0, 2), ("▁", -1.0, 1), ("a", -1.0, 1), ("b", -1.0, 1), ("▁a", -2.0, 1), ("ab", -2.0, 1), ("▁ab", -3.0, 1)]
    v = unigram.Vocabulary(pieces)
    assert unigram.Codec(v).encode("ab").tolist() == [6]
    assert unigram.TokenCounter(v).count("ab") == (-3.0, 1)
    assert unigram.TokenCounter(v).count("c") == (-1.0 + v.unknown_score, 2)


def test_unigram_operators(spark, docs):
    counted = {r["doc_id"]: r["n_pieces"] for r in unigram.count_tokens(docs).collect()}
    coded = unigram.encode(docs)
    assert all(len(r["ids"]) == counted[r["doc_id"]] for r in coded.collect() if r["doc_id"] is not None)
    back = {r["doc_id"]: r["text"] for r in unigram.decode(coded).collect()}
    assert all(back[r["doc_id"]] == (r["text"] or "") for r in docs.collect() if r["doc_id"] is not None)
    assert all(r["round_trip"] for r in unigram.query_codec(docs).collect())
    nothing = unigram.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()
    assert nothing["text"] == ""


# --- toxicity --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark, make_prose):
    prose = make_prose
    rows, labels = [], []
    for k in range(400):
        words = prose(1000 + k, 60).split(" ")
        if k % 5 == 0:
            for j in range(3, len(words), 12):
                words[j] = ("frumpnik", "gobzil", "frumpnax")[j % 3]
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + labels[:9] + [(None, 1), (7, None)], "doc_id long, toxic int")


def test_toxicity_on_held_out(labelled):
    docs, labels = labelled
    got = toxicity.query(docs, labels).collect()
    assert len(got) == 400 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0}
    right = sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held)
    assert right >= 0.95 * len(held)


def test_toxicity_never_learns_held_out_labels(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", __import__("pyspark").sql.functions.when(toxicity.held_out(labels["doc_id"]), 1 - labels["toxic"]).otherwise(labels["toxic"]))
    a, b = (rows_of(toxicity.query(docs, x).select("doc_id", "score")) for x in (labels, flipped))
    assert a == b


def test_toxicity_edge_cases(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.query(docs, labels).count() == docs.count()
    assert toxicity.query(no_docs, labels).count() == 0
    kept = toxicity.keep_clean(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_toxicity_learns_an_id_once(labelled):
    """Rows that repeat a labelled id, and labels that contradict each other, change nothing but that id."""
    docs, labels = labelled
    again = docs.filter("doc_id = 1")
    for _ in range(5):
        again = again.union(again)
    a = toxicity.fit(docs, labels)
    b = toxicity.fit(docs.union(again).repartition(4), labels.union(labels.filter("doc_id = 5 and toxic = 1")))
    assert a.lexicon == b.lexicon and a.trees.model == b.trees.model and all((x == y).all() for x, y in zip(a.knots, b.knots, strict=True))
    c = toxicity.fit(docs, labels.union(labels.sparkSession.createDataFrame([(5, 0), (10, 0)], "doc_id long, toxic int")))
    assert a.lexicon == c.lexicon


def test_toxicity_features_match_plain():
    lexicon = {"bad": 1.5, "worse": 2.5, "worst": 3.5, "hor-": 0.0, "horr-": 2.0}
    make = toxicity.Featurizer(lexicon, cache=3)
    for text in ("", "You are BAD!", "worst horrid horror b@d bad worse? you", "a " * 40 + "bad", "ÜBER bad-worse *** 12 x9y", "\n\t"):
        words = re.findall(r"[^\W\d_]+", text.lower())
        value = lambda w: max([lexicon.get(w, 0.0), *(lexicon.get(w[:k] + "-", 0.0) for k in range(3, 8) if len(w) > k)])
        scores = [value(w) for w in words]
        hits = [(i, x) for i, x in enumerate(scores) if x > 1]
        near = sum(any(abs(i - j) <= 5 and w in toxicity.SECOND for j, w in enumerate(words)) for i, _ in hits)
        n, size = max(1, len(words)), max(1, len(text))
        count = lambda least: sum(x > least for _, x in hits)
        top = (sorted((x for _, x in hits), reverse=True) + [0.0] * 3)[:3]
        want = [count(1) / n, count(2) / n, count(3) / n, count(1), count(2), count(3), *top, sum(x for _, x in hits) / n, near, near / n]
        want += [sum("A" <= c <= "Z" for c in text) / size, text.count("!") / n, text.count("?") / n, sum(c in "#*$%&|<>@" for c in text) / n]
        odd = re.findall(r"(?<=[^\W\d_])[0-9@$*_#!.\-]+(?=[^\W\d_])", text)
        want += [len(odd) / n, np.log1p(len(words)), len(text) / n, sum(w in toxicity.SECOND for w in words) / n]
        assert make.row(text) == pytest.approx(want), text


def plain_tree(x, g, h, k, depth, rate, penalty, bins):
    """Value of each row under the best splits, by trying every feature and bin."""
    value = rate * g.sum() / (h.sum() + penalty)
    best = (1e-6, None)
    if depth and len(g) >= 10:
        for j in range(x.shape[1]):
            for s in range(bins):
                left = x[:, j] <= s
                gain = sum(g[m].sum() ** 2 / (h[m].sum() + penalty) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + penalty)
                if gain > best[0] + 1e-9:
                    best = (gain, left)
    if best[1] is None:
        return np.full(len(g), value)
    out = np.empty(len(g))
    for m in (best[1], ~best[1]):
        out[m] = plain_tree(x[m], g[m], h[m], k, depth - 1, rate, penalty, bins)
    return out


def test_boosting_matches_plain():
    r = np.random.default_rng(2)
    x = np.round(r.standard_normal((200, 3)), 1)
    y = (x[:, 0] + x[:, 1] * (x[:, 2] > 0) + r.standard_normal(200) / 3 > 0.2).astype(float)
    trees = Boosted(trees=5, bins=8).fit(x, y)
    binned = np.stack([(x[:, j, None] >= c[None, :]).sum(axis=1) for j, c in enumerate(trees.cuts)], axis=1)
    raw = np.full(200, np.log(y.mean() / (1 - y.mean())))
    for _ in range(5):
        p = 1 / (1 + np.exp(-raw))
        raw = raw + plain_tree(binned, y - p, p * (1 - p), 0, 3, 0.15, 1.0, 8)
    assert trees.raw(x) == pytest.approx(raw)


def test_isotonic_matches_plain():
    r = np.random.default_rng(5)
    for n in (1, 2, 7, 60):
        raw, y = r.standard_normal(n), (r.random(n) < 0.4).astype(float)
        y = y[np.argsort(np.argsort(raw))]
        order = np.argsort(raw)
        t = y[order]
        fitted = [max(min(t[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        edges = [0, *(i for i in range(1, n) if fitted[i] > fitted[i - 1] + 1e-12), n]
        blocks = [slice(lo, hi) for lo, hi in zip(edges, edges[1:], strict=False)]
        xs, ys = isotonic(raw, y)
        assert xs == pytest.approx([raw[order][b].mean() for b in blocks])
        assert ys == pytest.approx(np.maximum.accumulate([(t[b].sum() + 0.5) / (len(t[b]) + 1) for b in blocks]))


def test_similar_short_texts_meet(spark):
    r = random.Random(11)
    rows, texts = [], {}
    for k in range(240):
        # Plain words, so that pairs are alone with each other.
        words = [f"{k}x{r.randrange(10**6)}" for _ in range(r.randint(20, 60))]
        extra = [f"{k}y{j}" for j in range(r.randint(1, 5))]
        at = r.randrange(len(words))
        other = [words + extra, extra + words, words[:at] + extra[:1] + words[at + 1 :]][k % 3]
        texts[2 * k], texts[2 * k + 1] = words, other
    rows = [(k, " ".join(w)) for k, w in texts.items()]
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in texts.items()}
    want = {(k, k + 1) for k in range(0, 480, 2) if len(sets[k] & sets[k + 1]) >= 0.8 * len(sets[k] | sets[k + 1])}
    got = {tuple(x) for x in similar.links(spark.createDataFrame(rows, "node long, text string")).collect()}
    assert len(want) > 100 and got == want


def test_similar_texts_of_unlike_lengths_meet(spark):
    words = [f"u{k}" for k in range(150)]
    rows = [(1, " ".join(words)), (2, " ".join(words + words[:120]))]
    assert [tuple(x) for x in similar.links(spark.createDataFrame(rows, "node long, text string")).collect()] == [(1, 2)]


# --- lm scoring ------------------------------------------------------------------------------------------


def plain_losses(rows, good, contexts):
    """(doc, tokens, background, target) by the definition: counts without the document's own of the word and the pair."""
    texts = [(k, ["<s>", *(t or "").lower().split()]) for k, t in rows]

    def model(some):
        pairs = Counter(p for _, t in some for p in zip(t, t[1:], strict=False))
        single, context = Counter(), Counter()
        for (v, w), n in pairs.items():
            single[w] += n
            context[v] += n
        return pairs, single, context, sum(pairs.values())

    every, aimed = model(texts), model([x for x in texts if x[0] in good])
    size, often = len(every[1]), {v for v, n in every[2].items() if v == "<s>" or n * contexts >= every[3]}
    out = []
    for k, t in texts:
        mine = model([(k, t)])
        sums = []
        for (pairs, single, context, total), out_of in ((every, 1), (aimed, k in good)):
            loss = 0.0
            for v, w in zip(t, t[1:], strict=False):
                less, twice = mine[1][w] * out_of, mine[0][v, w] * out_of
                low = (single[w] - less + 1) / (total - less + size)
                before = context[v] - twice
                high = (pairs[v, w] - twice) / before if before > 0 else low
                loss -= np.log(0.7 * high + 0.3 * low if v in often else low)
            sums.append(loss / max(1, len(t) - 1))
        out.append((k, len(t) - 1, *sums, sums[1] - sums[0]))
    return out


@pytest.mark.parametrize(("contexts", "part", "unit"), [(1 << 17, 2_000_000, 1_000_000), (300, 500, 700), (0, 100, 100)])
def test_lm_score_matches_plain(spark, monkeypatch, contexts, part, unit):
    monkeypatch.setattr(lm_score, "PART", part)
    monkeypatch.setattr(lm_score, "UNIT", unit)
    rows = [(k, " ".join(f"w{(k * 37 + i * i) % 4000}" for i in range(150))) for k in range(60)]
    rows += [(60, None), (61, "a b a c"), (62, "z z A"), (62, "z z A"), (63, ""), (64, rows[5][1]), (None, "w1 w2 never"), (None, "w1 w2 never")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([*((k, 1) for k in range(0, 63, 3)), (1, 0), (3, 0), (None, 1), (7, None), (99, 1)], "doc_id long, quality int")
    want = plain_losses(rows, {k for k in range(0, 63, 3)}, contexts)
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted((tuple(r) for r in lm_score.score(lm_score.fit(docs, labels, contexts)).collect()), key=order)
    assert len(got) == len(want)
    for g, x in zip(got, sorted(want, key=order), strict=True):
        assert g[:2] == x[:2] and g[2:] == pytest.approx(x[2:], abs=1e-4)
    by = {g[0]: g for g in got}
    assert by[64][2] < min(by[k][2] for k in (10, 11, 13)) - 0.2  # a text that stands twice


def test_lm_score_rare_words_are_contexts(spark):
    """One word of 200,000 tokens stands before another in three documents; the pair counts, however rare the word is."""
    rows = [(1, "rare next"), (2, "rare next"), (3, "rare next"), (4, "filler " * 200_000 + "next alone")]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in lm_score.query(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    every = {"rare": 3, "next": 4, "filler": 200_000, "alone": 1}
    n = sum(every.values())
    low = {w: every[w] / (n - 1 + 4) for w in ("rare", "next")}  # without its own one, and one more
    want = -sum(np.log(0.7 * x + 0.3 * low[w]) for w, x in (("rare", 2 / 3), ("next", 2 / 2))) / 2
    assert got[3]["background_loss"] == pytest.approx(want, abs=1e-6)


def test_lm_score_parts_see_a_frequent_pair_once_for_each_unit(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "UNIT", 1000)
    docs = spark.createDataFrame([(k, "same pair " * 10 + f"w{k}") for k in range(400)], "doc_id long, text string").coalesce(1)
    model = lm_score.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    asked = model.met.filter(f"kind = {lm_score.PAIRS}").select("b").collect()
    assert model.totals == (8400, 21) and model.size == 402 and lm_score.score(model).count() == 400
    assert sum(len(lm_score._unpack(r["b"])) // 2 for r in asked) == 2 * len(asked) + 400 + len(asked) < 600


def test_lm_score_long_text_and_many_labels(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BROADCAST", 0)
    rows = [(1, "long " * 200_000 + "x" * 1_000_000), (2, "short text"), (3, "short word")]
    labels = spark.createDataFrame([(2, 1), (2, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in lm_score.query(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert got[1]["n_tokens"] == 200_001 and got[3]["score"] < 0 < got[1]["background_loss"]


@pytest.mark.parametrize(("scale", "at_once"), [(1, 7), (1, 1 << 20), (1 << 33, 7)])
def test_lm_score_sums_of_units_match_plain(monkeypatch, scale, at_once):
    monkeypatch.setattr(lm_score, "RANGE", at_once)
    r = np.random.default_rng(4)
    hashes = [np.unique(r.integers(0, high, 60)) for high in (50, 1 << 62, 80, 1)]
    counts = [r.integers(0, 3, (2, len(x))) * scale for x in hashes]
    plain = [Counter(), Counter()]
    for x, y in zip(hashes, counts, strict=True):
        for k in (0, 1):
            plain[k].update(dict(zip(x.tolist(), y[k].tolist(), strict=True)))
    assert lm_score._add_up(hashes, counts) == sum(n > 0 for n in plain[0].values())
    assert [y.tolist() for y in counts] == [[[plain[k][h] for h in x.tolist()] for k in (0, 1)] for x in hashes]


def test_lm_score_losses_are_the_same_in_slices(monkeypatch):
    r = np.random.default_rng(6)
    sizes = np.array([0, 0, 5, 40, 0, 300, 1, 7, 90, 0])
    words = np.array([1, *np.sort(r.choice(1 << 40, 30, replace=False) + 2)])
    unit = lm_score.Unit(sizes, r.random(10) < 0.5, words, r.integers(1, 31, sizes.sum()).astype(np.int32))
    got = []
    for size in (1, 50, 1 << 20):
        monkeypatch.setattr(lm_score, "SLICE", size)
        got.append(np.array(unit.losses(unit.word_counts() + 3, unit.pair_counts() + 1, 40, (600, 300), None)).tolist())
    assert got[0] == got[1] == got[2] and [x > 0 for x in got[0][0]] == [n > 0 for n in sizes.tolist()]


FREED = """
from pathlib import Path
from pyspark.sql import SparkSession
from sparkloom.llm import lm_score

conf = {"spark.local.dir": FOLDER, "spark.cleaner.referenceTracking": "false", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "3"}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
docs = spark.range(3000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 30), x -> hash(id, x))) as text")
model = lm_score.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
left = sum(f.stat().st_size for f in Path(FOLDER).rglob("shuffle_*.data"))
print("left", left, model.totals[0], lm_score.score(model).count(), sum(f.stat().st_size for f in Path(FOLDER).rglob("shuffle_*.data")), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None))
"""


def test_lm_score_frees_what_the_units_asked(tmp_path):
    """The files of the first shuffle go before those of the second one come, even if no garbage is collected."""
    run = subprocess.run([sys.executable, "-c", f"FOLDER = {str(tmp_path)!r}{FREED}"], capture_output=True, text=True, timeout=300, check=True, cwd=Path(__file__).parents[2])
    left, tokens, rows, then, setting = run.stdout.split("left", 1)[1].split()
    assert (int(tokens), int(rows), setting) == (90_000, 3000, "None")
    assert int(left) < 10_000 < 500_000 < int(then)


# --- the same hard cases for all -------------------------------------------------------------------------


def test_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (quality.query, quality.clean, line_dedup.query, line_dedup.clean, simhash.query, simhash.keep_first, packing.pack, unigram.count_tokens, unigram.query_codec):
        assert f(no_docs).count() == 0, f
    assert lm_score.query(no_docs, labels).count() == 0
    assert toxicity.query(no_docs, labels).count() == 0


def test_extra_columns_with_clashing_names(spark, clashing):
    n = clashing.count()
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for f in (quality.query, line_dedup.query, simhash.query, unigram.count_tokens, unigram.query_codec):
        assert f(clashing).count() == n, f
    assert packing.pack(clashing).select("doc_id").distinct().count() == n
    assert lm_score.query(clashing, labels).count() == n and toxicity.query(clashing, labels).count() == n
    for f in (quality.clean, line_dedup.clean, simhash.keep_first):
        got = f(clashing)
        assert got.columns == clashing.columns and 0 < got.count() <= n
