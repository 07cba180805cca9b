"""Rows that operators must stand: nulls, empty and long texts, ties, repeated rows, signs of every kind."""

LONG = " ".join(f"word{i % 997} and" for i in range(30_000))
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""),
    (4, "Alpha  beta\tgamma delta epsilon\nzeta eta theta"), (None, "a text without an id that goes on for some words"),
    (1, "Alpha beta gamma delta epsilon zeta eta theta"), (5, "x" * 300_000), (6, " \n\t "), (7, LONG),
    (8, "É ﬁne 漢字 🙂 İstanbul ΑΣ\nAlpha beta gamma delta epsilon zeta eta theta"), (9, LONG + " end"),
    (None, None), (10, "the the the the the the the the"), (11, "Alpha beta gamma delta epsilon zeta eta THETA"),
]
