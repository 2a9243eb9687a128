"""Texts that the tests of the text operators share."""

import random

ODD = [
    (900_001, None),
    (900_002, ""),
    (900_003, " \t\n "),
    (900_004, "one two three"),
    (900_005, "One TWO three"),
    (900_006, "żółć naïve 東京 🙂 ﬁ İ́"),
    (900_007, "a" * 5000),
    (900_008, "word " * 30_000),
    (900_009, "tail\r\n\x00\x1c end"),
]


def corpus(seed=5, n=120):
    """Distinct, copied and edited texts with shared passages, blank and long ones: (doc_id, text) rows in a random order."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([3, 7, 40, 120, 300]))]
        if r.random() < 0.3:
            words = words + passage.split()
        rows.append((i, " ".join(words)))
        if r.random() < 0.3:
            copies = r.randint(1, 12)
            for c in range(copies):
                w = list(words)
                for _ in range(r.choice([0, 0, 1, 3, 8])):
                    w[r.randrange(len(w))] = r.choice(vocabulary)
                rows.append((1000 * (c + 1) + i, " ".join(w)))
    rows += ODD
    r.shuffle(rows)
    return rows
