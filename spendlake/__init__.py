"""spendlake: bank-transaction cleaning, categorization, dedupe and incremental loads on
Spark. Every public function takes and returns DataFrames / Columns.

    from spendlake import categorize, read_statements, append_new
"""
from spendlake.functions.similarity import lcs, token_set_ratio
from spendlake.functions.text import (
    column_name, description_key, extract_merchant, merchant_name, normalize_column_name, title_case,
)
from spendlake.functions.values import add_transaction_id, parse_amount, parse_date, transaction_hash
from spendlake.operators.categorize import categorize, categorize_learn, fuzzy_best, keyword_first
from spendlake.operators.dedupe import find_duplicates, find_near_duplicates, remove_duplicates
from spendlake.operators.memory import learn_batch
from spendlake.operators.rules import DEFAULT_RULES, extend_rules, replace_rules, rules_frame
from spendlake.operators.summaries import (
    account_summary, budget_vs_actual, category_summary, merchant_summary, monthly_summary,
    period_over_period, run_counters,
)
from spendlake.plans.pipeline import run_pipeline
from spendlake.sources.ingest import classify_files, normalize_table, read_statements
from spendlake.sources.ledger import pending, upsert as upsert_ledger
from spendlake.sources.lines import parse_cells, parse_lines
from spendlake.sources.sink import append_new, existing_ids, new_rows, to_transactions, write_csv

__all__ = [n for n in dir() if not n.startswith("_")]
