"""The texts that the SQL twins expect, written out apart from the
operators that they check. @name@ marks what a query fills in."""

ASK = ('Answer the question with a short factual span only — no preamble, no explanation, no period. '
       'If you cannot answer, output "unknown".\n\nQuestion: @query@\nShort answer:')

TWO_PART = """<primary_semantic_context>
@primary@
</primary_semantic_context>

<structurally_linked_context>
@structural@
</structurally_linked_context>

System: Synthesize the primary context to answer the user's query.
Use the structurally linked context to draw broader multi-hop connections if the primary context is missing direct evidence.
""" + ASK

FLAT = """<context>
@context@
</context>

""" + ASK

JUDGE = """You are a strict evaluator for short-answer QA.

The gold answer below is from a multi-hop QA benchmark. Mark the predicted
answer CORRECT if it conveys the same factual meaning as the gold answer —
accept differences in casing, articles, punctuation, abbreviation,
paraphrasing, or partial spans that uniquely identify the gold entity.
Mark INCORRECT if the prediction contradicts the gold, introduces a different
entity, hedges with "unknown" when the gold is a real entity, or is too
ambiguous to identify the gold answer.

Question: @query@
Gold answer: @gold@
Predicted answer: @pred@

Reply with ONLY a JSON object like {"correct": true_or_false, "rationale": "one short sentence"}."""


def filled(text: str, **values: str) -> str:
    """`text` as a SQL expression, each @name@ replaced by the expression given for it."""
    out = "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, expression in values.items():
        out = out.replace(f"@{name}@", f"' || {expression} || '")
    return f"({out})"
