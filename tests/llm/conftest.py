import pytest

#: Documents with every awkward case: null and empty texts, ties, repeated rows, very long texts, clashing columns.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(seed, n):
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 97))
    return " ".join(out)


@pytest.fixture(scope="session")
def awkward(spark):
    passage = sentence(99, 60)
    texts = {
        0: None, 1: "", 2: " \n\t ", 3: "one", 4: sentence(1, 80), 5: sentence(1, 80), 6: sentence(1, 80) + " tail", 7: "é" * 3000 + " ünï 日本 🙂",
        8: sentence(2, 30) + " " + passage + " " + sentence(3, 30), 9: sentence(4, 40) + "\n" + passage + "\n" + sentence(5, 20), 10: "word " * 400,
        11: "\n".join(["same line here"] * 9), 12: sentence(6, 4000), 13: "A!! " * 70, 14: "x*** y&&& | z### " * 30, 15: "<|endoftext|> a\x1cb c d\r\nit's",
    }
    rows = [(i, t, "doc", i, "k") for i, t in texts.items()] + [(4, texts[4], "doc", 4, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, part string, key long, score string")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
