"""SQL pieces that several queries share."""

from __future__ import annotations

# White space as Unicode has it; fixed values.
BLANKS = "||".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_END = r"\r\n|[\n\x{0B}\f\r\x{85}\x{2028}\x{2029}]"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def norm(x: str) -> str:
    return f"lower({strip(x)})"


def json_text(x: str, key: str) -> str:
    return f"CASE WHEN json_valid({x}) AND starts_with(ltrim({x}), '{{') THEN json_extract_string({x}, '$.{key}') END"


ITEMS = f"""items AS (SELECT *, {norm('id')} AS item_key FROM benchmark_items QUALIFY row_number() OVER (PARTITION BY {norm('id')} ORDER BY loaded_at DESC, coalesce(prompt, '') DESC, coalesce(reference_answer, '') DESC) = 1)"""
RESPONSES = f"""responses AS (SELECT *, {norm('benchmark_item_id')} AS item_key, lower(model_name) AS model_key FROM llm_responses QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, coalesce(response_text, '') DESC) = 1)"""
SCORES = f"""scores AS (SELECT {norm('benchmark_item_id')} AS item_key, lower(model_name) AS model_key, id, score, judge_model, loaded_at FROM judge_scores WHERE {norm('benchmark_item_id')} <> '' QUALIFY row_number() OVER (PARTITION BY {norm('benchmark_item_id')}, lower(model_name) ORDER BY loaded_at DESC, id DESC) = 1)"""
RESULTS = f"""{ITEMS}, {RESPONSES}, {SCORES}, results AS (SELECT r.id, r.item_key, r.model_key, r.response_text, r.error, r.latency_ms, r.finished_at, r.loaded_at, lower(i.task_type) AS task_type, i.title, i.prompt, i.reference_answer, i.source_category, s.score, CASE WHEN s.score BETWEEN 1 AND 5 THEN s.score END AS valid FROM responses r JOIN items i USING (item_key) LEFT JOIN scores s USING (item_key, model_key))"""
