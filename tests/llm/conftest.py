import pytest

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu".split()


def sentence(seed: int, n: int) -> str:
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x >> 16 & 31 if (x >> 16 & 31) < 26 else x >> 8 & 15] + str(x >> 20 & 7))
    return " ".join(out)


LONG = " ".join(sentence(s, 50) for s in range(60))


@pytest.fixture(scope="session")
def rows():
    """doc_id, text, lang, source, n_chars: nulls, empty and long texts, copies, near copies, repeated rows."""
    base = sentence(1, 120)
    near = base.split()
    near[50] = "changed"
    texts = {
        0: base, 1: base, 2: " ".join(near), 3: "", 4: None, 5: "one", 6: "one two", 7: " \n\t ", 8: LONG, 9: "Ünïcode straße " + sentence(3, 30),
        10: sentence(4, 60) + "\n" + sentence(5, 60) + "\nshort", 11: "intro\n" + sentence(5, 60) + "\n" + sentence(6, 40), 12: sentence(7, 9) + " " + sentence(7, 9) + " " + sentence(7, 9),
        13: "### $$$ %%% " + sentence(8, 5), 14: sentence(9, 70), 15: sentence(10, 70) + " " + " ".join(sentence(9, 70).split()[20:45]), 100: sentence(11, 20) + "\x00\x1c end",
    }
    out = [(i, t, ("en", "de", None)[i % 3], "s", len(t or "")) for i, t in texts.items()]
    return [*out, out[0], (None, "no id " + sentence(12, 30), "en", "s", 1), (14, sentence(13, 25), "de", "t", 2)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same with columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = "fp rk fingerprint component_id kept score hits words n_tokens ids gone line node a b k t part load met item held c h slot task".split()
    names += "pg_rk __pg_rk pg_kept pg_hit __pg_hit pg_n __pg_new pg__rk pg_gone pg_new __pg_gone pg_words pg_id".split()
    return docs.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


def untouched(df, original):
    """Whether the columns named like operators' own still hold what the caller put there."""
    from functools import reduce

    from pyspark.sql import functions as F

    own = [c for c in original.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    return df.columns == original.columns and not df.where(reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe("x") for c in own))).count()


def data(df):
    return [tuple(r) for r in df.collect()]


def same(a, b):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(a, key=key) == sorted(b, key=key)
