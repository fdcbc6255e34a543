from pyspark.sql import functions as F

from fieldweave.llm import preference_format as pref

TURNS = "conv_id long, turn int, role string, text string, pair_id string"


def pairs(spark, rows):
    turns = spark.createDataFrame(rows, TURNS)
    return {r.pair_id: r for r in pref.format_preferences(turns, F.floor(F.col("conv_id") / 2), F.pmod("conv_id", F.lit(2)) == 0).collect()}


def test_longest_common_prefix_and_masks(spark):
    both = [("system", "s"), ("user", "q"), ("assistant", "a1")]
    chosen, rejected = both + [("user", "more"), ("assistant", "yes")], both + [("user", "more"), ("assistant", "no!"), ("user", "eh")]
    got = pairs(spark, [(c, i, r, t, "x") for c, turns in ((0, chosen), (1, rejected)) for i, (r, t) in enumerate(turns)])[0]
    assert got.n_prompt_turns == 4 and got.prompt.startswith("<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n")
    mask = lambda text, spans: [text[int(a) : int(b)] for a, b in (s.split("-") for s in spans.split(";"))]
    assert mask(got.chosen, got.chosen_mask) == ["yes<|end|>"] and mask(got.rejected, got.rejected_mask) == ["no!<|end|>"]
    assert got.chosen == "<|assistant|>\nyes<|end|>\n" and got.rejected.endswith("<|user|>\neh<|end|>\n")


def test_odd_pairs(spark):
    got = pairs(spark, [(2, 0, "user", "a", None), (3, 0, "user", "a", None), (4, 1, None, None, None), (4, 0, "user", "b", None), (None, 0, "user", "c", None), (6, 0, "user", "x" * 50000, None), (7, 0, "assistant", "", None)])
    assert set(got) == {1, 2, 3}
    assert (got[1].n_prompt_turns, got[1].chosen, got[1].rejected, got[1].chosen_mask) == (1, "", "", "")
    assert (got[2].n_prompt_turns, got[2].prompt, got[2].rejected) == (0, "", "") and got[2].chosen.endswith("<||>\n<|end|>\n")
    assert got[3].rejected_mask == "14-21"
    assert pref.format_preferences(spark.createDataFrame([], TURNS), F.col("conv_id"), F.lit(True)).count() == 0
