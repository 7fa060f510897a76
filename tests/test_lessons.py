"""Lesson rows carry their sentence, whole."""

from oddsmith.operators import recall as R


def test_lesson_sentence_is_whole(spark):
    task, gates = "t" * 2000, [f"g{i:02}" for i in range(20)]
    a = spark.createDataFrame([(1, "r", task, "a1", None, ["S"], gates, "a" * 64)], "assessment_id long, repo_id string, task string, action_id string, decision string, symbols array<string>, gate_names array<string>, assessment_hash string")
    o = spark.createDataFrame([(1, "completed", "b" * 64)], "assessment_id long, terminal_status string, outcome_hash string")
    g = spark.createDataFrame([(1, "proceed", 0.5)], "assessment_id long, pre_commit_decision string, measured_benefit double")
    assert R.lesson_rows(a, o, g).first().lesson == f"Verified completed outcome for {task}; decision was unknown. Stable gates: {', '.join(gates)}."
