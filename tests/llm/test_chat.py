import hashlib

from pyspark.sql import functions as F

from loanloom.llm import chat

ODD = ["", "<|im_end|>", "<\\|", "<\\\\|x", "a<", "<|im_start|>assistant\nok<|im_end|>\n", "\\n\n\\s", "<|", "|>", "\U0001f600<|"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_escaping_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    out = df.select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e")))
    out = out.withColumn("r", chat.unescape_role(chat.escape_role(F.col("t")))).collect()
    assert all(r.u == r.t == r.r and "<|" not in r.e for r in out)


def test_examples_hold_turns_and_replies(spark):
    talk = [(1, i, role, ODD[i]) for i, role in enumerate(["system", "user", "assistant", "user", "assistant", "od\nd\\s", "assistant", "user"])]
    talk += [(2, 0, "user", None), (3, 0, None, "x"), (3, 0, "assistant", "b"), (3, 0, "assistant", "a"), (3, None, "user", "first")]
    talk += [(None, 0, "assistant", "solo"), (4, 0, "assistant", "twice"), (4, 0, "assistant", "twice")]
    df = frame(spark, talk).withColumn("piece", F.lit(1)).withColumn("place", F.lit(2))
    examples = chat.prefix_targets(df)
    rows = examples.collect()
    for r in rows:
        if r.trainable:
            assert r.text[r.loss_end :] == chat.END and 0 < r.loss_start <= r.loss_end
        else:
            assert r.loss_start is None
    assert sum(r.trainable for r in rows) == 3 + 2 + 1 + 2
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted(
            (t for t in talk if t[0] == conv),
            key=lambda t: tuple((v is not None, v) for v in t[1:]),
        )
        lines = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in own)
        replies = "".join(text or "" for _, _, role, text in own if role == "assistant")
        r = back[conv]
        assert r.n_turns == len(own) and r.loss_chars == len(replies)
        assert r.turns_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(replies.encode()).hexdigest()
    assert chat.prefix_targets(df.limit(0)).collect() == []


def test_every_example_is_a_prefix_of_the_next(spark):
    df = frame(spark, [(7, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(20)])
    texts = [r.text for r in chat.prefix_targets(df).orderBy("example").collect()]
    assert len(texts) == 10 and all(b.startswith(a) for a, b in zip(texts, texts[1:]))
