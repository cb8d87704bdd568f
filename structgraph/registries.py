"""Registries of ids and names."""

from __future__ import annotations

# Ids are a contract.
NODE_KINDS = {
    1: "module", 2: "class", 3: "function", 4: "method", 5: "route", 6: "package", 7: "interface", 8: "struct", 9: "endpoint", 10: "enum",
    11: "grpc_service", 12: "grpc_client", 13: "queue_consumer", 14: "queue_producer", 15: "graphql_resolver", 16: "graphql_operation",
    17: "ws_handler", 18: "ws_client", 19: "event_handler", 20: "event_emitter", 21: "cli_command", 22: "cli_invocation", 23: "database",
    24: "cache", 25: "blob_store", 26: "search_index", 27: "email_service", 28: "component", 29: "hook", 30: "service", 31: "directive",
    32: "pipe", 33: "guard", 34: "composable",
}
EDGE_CATEGORIES = {
    1: "defines", 2: "contains", 3: "imports", 4: "calls", 5: "uses", 6: "documents", 7: "tests", 8: "injects", 9: "handled_by",
    10: "http_calls", 11: "grpc_calls", 12: "queue_flows", 13: "graphql_calls", 14: "ws_connects", 15: "event_flows", 16: "shares_schema",
    17: "cli_invokes", 18: "accesses_data",
}
CELL_TYPES = {
    1: "code", 2: "doc", 3: "position", 4: "intent", 5: "route_method", 6: "endpoint_hit", 7: "test", 8: "attn", 9: "fail", 10: "constraint",
    11: "decision", 12: "env", 13: "conv", 14: "vector",
}
CONFIDENCE = {2: "strong", 1: "medium", 0: "weak"}
#: Ranking weights of edge categories; any other has 1.
WEIGHTS = {
    4: 5.0, 10: 5.0, 11: 5.0, 13: 5.0, 12: 4.0, 14: 4.0, 15: 4.0, 9: 4.0, 17: 3.0, 3: 3.0, 5: 3.0, 16: 2.0, 7: 2.0, 8: 2.0, 1: 1.0,
    2: 1.0, 6: 0.5,
}
#: Kinds that a flow starts from.
ENTRY_KINDS = (5, 11, 13, 15, 17, 19, 21)
#: Path segments that mark code as not critical.
NONCRITICAL = ("tests", "test", "__tests__", "spec", "specs", "fixtures", "fixture", "examples", "example", "e2e", "__mocks__", "mocks", "testdata")
#: Leading path segments that may be dropped to match an endpoint with a route.
DROPPABLE = ("protected", "api", "public", "internal", "v1", "v2", "v3")

KIND = {v: k for k, v in NODE_KINDS.items()}
CATEGORY = {v: k for k, v in EDGE_CATEGORIES.items()}
CELL = {v: k for k, v in CELL_TYPES.items()}
