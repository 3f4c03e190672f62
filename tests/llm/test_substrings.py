import random

from palaver.llm import substrings
from palaver.llm.substrings import remove_repeats


def brute(texts):
    split = [[w for w in t.replace("\t", " ").replace("\n", " ").split(" ") if w] if t else [] for t in texts]
    seen = {}
    for d, words in enumerate(split):
        for i in range(len(words) - 34):
            seen.setdefault(tuple(words[i : i + 35]), []).append((d, i))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + 35))
    return [(len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for w, g in zip(split, gone, strict=True)]


def corpus(seed):
    rng = random.Random(seed)

    def words(n, kinds=50):
        return [f"w{rng.randrange(kinds)}é" for _ in range(n)]

    shared = [words(34), words(35), words(36), words(80)]
    texts = [None, "", "\n", "a " * 200, "b " * 36, "b " * 35 + "c"]
    for _ in range(40):
        parts = words(rng.randrange(60))
        for _ in range(rng.randrange(4)):
            parts += rng.choice(shared) + words(rng.randrange(10))
        texts.append(" ".join(parts))
    near = words(300)
    for _ in range(15):
        copy = list(near)
        copy[rng.randrange(300)] = "edit"
        texts.append(" \n".join(copy))
    return texts + texts[:12] + [texts[20]] * 5


def test_equals_brute_force(frame, monkeypatch):
    monkeypatch.setattr(substrings, "TREE_ROWS", 300)
    texts = corpus(1)
    rows = [(None if i % 9 == 0 else i // 2, t, "kept") for i, t in enumerate(texts)]
    for parts in (1, 7):
        got = remove_repeats(frame(rows, "doc_id long, text string, kept string", parts)).collect()
        want = [(r[0], *b) for r, b in zip(rows, brute(texts), strict=True)]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_no_rows(frame):
    assert remove_repeats(frame([], "doc_id long, text string")).count() == 0
