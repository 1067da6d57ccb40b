"""Every query of the library (the training-data subpackage apart) and its SQL."""

from quillgrid.operators import answer_queries, bundle_queries, finance_queries, graph_queries, investment_queries, l_table_queries, model_queries, recalc_queries, signature_queries, simulation_queries, structure_queries, table_queries, whatif_more, whatif_queries, workspace_queries

MODULES = [answer_queries, bundle_queries, finance_queries, graph_queries, investment_queries, l_table_queries, model_queries, recalc_queries, signature_queries, simulation_queries, structure_queries, table_queries, whatif_more, whatif_queries, workspace_queries]
QUERIES = {k: v for m in MODULES for k, v in m.registry.queries.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.registry.sql.items()}
