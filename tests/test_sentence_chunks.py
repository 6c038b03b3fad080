import random
import re

from pyspark.sql import functions as F

from sourcewell.operators.drafts import sentence_chunks


def written_out(text, most):
    done, held = [], ""
    for s in re.split(r"(?<=[。！？.!?;；])", text or ""):
        if held and len(held) + len(s) > most:
            done.append(held)
            held = ""
        held += s
    return done + [held] if held else done


def test_chunks_equal_a_loop(spark):
    rng = random.Random(4)
    texts = [None, "", "no end", "One. Two! Three? 四。五；", "x" * 50 + ".", "." * 7]
    texts += ["".join(rng.choices("ab .!。;", k=rng.randint(0, 90))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for most in (1, 12, 400):
        got = {r.i: r.c for r in df.select("i", sentence_chunks("text", most).alias("c")).collect()}
        assert got == {i: written_out(t, most) for i, t in enumerate(texts)}
        assert all("".join(got[i]) == (t or "") for i, t in enumerate(texts))
