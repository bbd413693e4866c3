"""Table schemas, enumerations, identifiers and edge-direction policies."""

from __future__ import annotations

NODE_TYPES = ["code_entity", "code_file", "config_key", "data_asset", "env_var", "infra_module", "infra_resource", "job", "secret", "unknown"]
EDGE_TYPES = ["calls", "configures", "consumes", "contains", "depends_on", "extends", "imports", "provides", "provisions", "reads", "routes_to", "transforms", "writes"]
STRATEGIES = ["contains", "exact", "normalized", "prefix", "semantic", "suffix", "token_overlap"]

NODES = "id string, name string, type string, path string, language string, file_hash string, tokens array<string>, metadata string, created_at timestamp, source_repo string"
EDGES = "source_id string, target_id string, type string, confidence double, match_strategy string, metadata string, created_at timestamp"
SCANS = "file_path string, file_hash string, last_scanned timestamp, node_count int, edge_count int"
SUPPRESSIONS = "id string, source_pattern string, target_pattern string, reason string, created_by string, created_at timestamp, expires_at timestamp, enabled boolean"
MAPPINGS = "source string, target string, mapping_type string, reason string"


def columns(schema: str) -> list[str]:
    """Column names of a flat schema string."""
    return [f.split()[0] for f in schema.split(", ")]


EDGE_KEY = ["source_id", "target_id", "type"]

#: Which way an edge of each type carries impact; 'untyped' follows every edge forward.
POLICIES: dict[str, dict[str, list[str]]] = {
    "core": {"forward": ["flows_to", "outputs", "provides", "provisions", "writes"], "reverse": ["calls", "depends_on", "reads"]},
    "lineage": {
        "forward": ["calls", "configures", "flows_to", "outputs", "provides", "provisions", "transforms", "triggers", "writes"],
        "reverse": ["consumes", "depends_on", "imports", "reads", "requires"],
    },
    "untyped": {},
}
