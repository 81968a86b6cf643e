"""The pipeline in plain Python, but for the fitted model of toxicity, which is the operator's own."""

import re

from test_documents import plain_counts, plain_dedup, plain_fingerprint, words_of

from sparkloom.llm import toxicity

NOTICE = re.compile(r"(?i)\b(all rights reserved|licen[sc]ed under|released under the|copyright|cookies?|privacy policy|terms of (use|service)|log ?in|sign (in|up)|subscribe|click here|read more|share this)\b")


def line_stays(line):
    n = len(words_of(line))
    symbols, bars, bangs = (sum(map(line.count, c)) for c in ("#*$%&|<>", "|»›•", "!"))
    letters = [c for c in line if c.isalpha()]
    shout = bangs >= 2 and bangs * 2 >= n >= 3 and bool(letters) and not any(c.islower() for c in letters)
    bad = (bars >= 3 and bars * 4 >= n) or (symbols >= 3 and symbols * 5 > n) or shout
    bad = bad or (n < 3 and not re.search(r"[.!?…:;,\"'”’)\]][\x20\x09-\x0D]*$", line)) or (n <= 30 and NOTICE.search(line))
    return not (n and bad)


def plain_quality(docs):
    out = {}
    for k, t in docs.items():
        n, _, _, _, repeat = plain_counts(t)
        clean = "\n".join(x for x in (t or "").split("\n") if line_stays(x))
        if n >= 20 and 100 * repeat <= 30 * n and (n - len(words_of(clean))) * 2 <= n:
            out[k] = clean
    return out


def pieces_of(rows):
    """doc -> crc of the whole document's ids is not in the rows, so: doc -> sorted (start, length, crc, tokens)."""
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    return {k: sum(n for _, n, _, _ in v) == v[0][3] and v[0][3] for k, v in out.items()}


def similarity(a, b, size=5):
    x, y = ({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in ([v.lower() for v in words_of(t)] for t in (a, b)))
    return len(x & y) / len(x | y)


def plain_groups(texts, least=0.8):
    """id -> smallest id reachable over fingerprints within 3 bits and similar shingle sets."""
    prints = {k: plain_fingerprint(t, 5) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    order = sorted(texts)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3 or (words_of(texts[a]) and words_of(texts[b]) and similarity(texts[a], texts[b]) >= least):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in order}


def plain_pipeline(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    from sparkloom.llm import byte_bpe

    texts = plain_quality(docs)
    stage = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = toxicity.fit(stage, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = model.scores(toxicity.Featurizer(model.lexicon).table(list(texts.values())))
    texts = {k: t for (k, t), s in zip(texts.items(), scores, strict=True) if s < 0.5}
    cleaned = plain_dedup(list(texts.items()))
    texts = {k: cleaned[k, t] for k, t in texts.items() if not words_of(t) or words_of(cleaned[k, t])}
    parts = plain_groups(texts)
    texts = {k: t for k, t in texts.items() if parts[k] == k}
    coder = Tokenizer.from_file(byte_bpe.default_path())
    sizes = {k: len(coder.encode(t, add_special_tokens=False).ids) + 1 for k, t in texts.items()}
    return {"texts": texts, "pieces": sizes}
