import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def components(texts, percent):
    """doc_id -> smallest id reachable, by comparing all pairs."""
    ids = sorted(texts)
    sets = {i: shingles(texts[i]) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus(seed=0, copies=60):
    """Texts with exact copies, a cloud of near copies larger than a hot posting list, a shared passage, and odd ones."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    texts, base, passage = [], prose(120), prose(50)
    for _ in range(copies):
        near = list(base)
        for _ in range(draw.randrange(5)):
            near[draw.randrange(len(near))] = draw.choice(vocabulary)
        texts.append(" ".join(near))
    texts += [" ".join(base)] * 5
    texts += [" ".join(prose(60) + passage + prose(60)) for _ in range(45)]
    for _ in range(10):
        one = prose(40)
        texts += [" ".join(one), " ".join(one[:-1] + ["x"]).upper(), " ".join(one[:20])]
    texts += ["", " \n", "a", "A", "a b c", "a b c d e", "é" * 9, None, " ".join(prose(20_000))]
    draw.shuffle(texts)
    return {i: t for i, t in enumerate(texts)}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (2, None, None, None, None), (3, "", "en", "", 0),
        (None, "no id at all in this row here", "en", "a", 5), (4, " \t\n", "en", "b", 3), (5, "ONE two three four five six", "en", None, 27), (6, "x " * 50_000, "en", "b", 100_000), (7, "é", "fr", "b", 1),
    ]
    wide = [(*r, 9, "q", 1.5, 2) for r in rows]
    return spark.createDataFrame(wide, DOCS + ", token long, queue string, __score double, size long")


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def plain_mix(rows, packet, weights=(3, 1, 2), budget=1.5, epochs=2, seed="mix-1"):
    """doc_id to words taken: every packet of every queue in one list by virtual finish time, cut at the budget."""
    queues = {}
    for i, text, source in rows:
        queues.setdefault((source is None, source or ""), []).append((hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), len(WORD.findall(text or "")), i))
    total = sum(size for q in queues.values() for _, size, _ in q)
    weigh = {k: weights[n % 3] for n, k in enumerate(sorted(queues))}
    full = {k: sum(size for _, size, _ in q) for k, q in queues.items()}
    stopped = set()
    while True:
        level = (total * budget - sum(epochs * full[k] for k in stopped)) / sum(weigh[k] for k in queues if k not in stopped)
        then = {k for k in queues if level * weigh[k] > epochs * full[k]}
        if then == stopped:
            break
        stopped = then
    packets = []
    for k, q in queues.items():
        for epoch in range(epochs):
            at = epoch * full[k]
            for _, size, i in sorted(q):
                for p in range(0, size, packet):
                    n = min(packet, size - p)
                    packets.append(((at + p + n) / min(level * weigh[k], epochs * full[k]), k, at, p, n, i))
                at += size
    left, taken = int(total * budget), {i: 0 for i, _, _ in rows}
    for *_, n, i in sorted(packets):
        taken[i] += min(n, left)
        left -= min(n, left)
    return taken
