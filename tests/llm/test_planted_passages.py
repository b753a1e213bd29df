"""op1 on planted passages: those of 400 bytes or more go from every document that has them, shorter ones and all else stay."""

import random

from graphloom.llm import suffix_dedup


def test_planted_passages_go_by_bytes_and_n_bytes_is_the_length(spark):
    r = random.Random(8)

    def prose(words: int) -> str:
        return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(4, 8))) for _ in range(words))

    rows, expected = [], {}
    for i in range(12):  # in three documents each: passages of over 60 words, and of 51 to 55 that are short of 400 bytes
        long, short = prose(r.randint(62, 120)), prose(r.randint(51, 55))
        long, short = long + "x" * (400 - len(long)), short[:380]
        assert len(long) >= 400 and len(short.split()) > 50
        for j in range(3):
            for kind, passage, gone in ((0, long, len(long)), (1, short, 0)):
                key = 100 * kind + 10 * 100 * i + j
                rows.append((key, f"{prose(r.randint(0, 80))}\n{passage}\n{prose(r.randint(0, 80))}"))
                expected[key] = gone
    for i in range(40):
        rows.append((100_000 + i, prose(r.randint(1, 300))))
        expected[100_000 + i] = 0
    got = {x["id"]: x for x in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=400).collect()}
    for key, text in rows:
        # bytes beside a passage may agree by chance (the line break, and a letter or two)
        assert expected[key] <= got[key]["n_removed"] <= (expected[key] + 8 if expected[key] else 0), key
        assert got[key]["n_spans"] == (1 if expected[key] else 0) and got[key]["n_bytes"] == len(text)
