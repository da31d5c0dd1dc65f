"""Fixed values. Results depend on them, so they are listed here as they are and nowhere else."""

import math

# ---- keys -------------------------------------------------------------------------------------
GROUP = ["session_id", "deployment_version", "environment"]
AGENT = ["session_id", "environment"]
PAIR = ["session_id", "environment", "baseline_version", "current_version"]

# ---- fixed values: the twelve dimensions, in report order --------------------------------------
DIMS = [
    "decision_drift",
    "semantic_drift",
    "latency",
    "error_rate",
    "tool_distribution",
    "verbosity_ratio",
    "loop_depth",
    "output_length",
    "tool_sequence",
    "retry_rate",
    "time_to_first_tool",
    "tool_sequence_transitions",
]

# ---- fixed values: composite weights used when a pair has no calibrated weights ----------------
FALLBACK_WEIGHTS = {
    "decision_drift": 0.38,
    "semantic_drift": 0.08,
    "latency": 0.12,
    "error_rate": 0.12,
    "tool_distribution": 0.08,
    "verbosity_ratio": 0.06,
    "loop_depth": 0.06,
    "output_length": 0.04,
    "tool_sequence": 0.04,
    "retry_rate": 0.04,
    "time_to_first_tool": 0.02,
    "tool_sequence_transitions": 0.0,
}

# ---- fixed values: weights of the resampled composite ------------------------------------------
RESAMPLE_WEIGHTS = {
    "decision": 0.40,
    "latency": 0.12,
    "errors": 0.12,
    "semantic": 0.08,
    "output": 0.04,
    "verbosity": 0.06,
    "loop": 0.06,
    "output_length": 0.04,
    "tool_sequence": 0.04,
    "retry": 0.04,
}

# ---- fixed values: preset weights per use case (order of PRESET_DIMS) --------------------------
PRESET_DIMS = [
    "decision_drift",
    "error_rate",
    "tool_sequence",
    "latency",
    "semantic_drift",
    "tool_sequence_transitions",
    "tool_distribution",
    "loop_depth",
    "time_to_first_tool",
    "verbosity_ratio",
    "retry_rate",
    "output_length",
]
PRESETS = {
    "FINANCIAL": [0.30, 0.18, 0.15, 0.10, 0.08, 0.05, 0.05, 0.04, 0.02, 0.01, 0.01, 0.01],
    "CUSTOMER_SUPPORT": [0.26, 0.13, 0.14, 0.11, 0.10, 0.06, 0.09, 0.01, 0.04, 0.01, 0.05, 0.00],
    "RESEARCH_RAG": [0.09, 0.02, 0.16, 0.05, 0.12, 0.04, 0.13, 0.00, 0.01, 0.16, 0.00, 0.22],
    "CODE_GENERATION": [0.09, 0.28, 0.17, 0.05, 0.04, 0.08, 0.03, 0.13, 0.01, 0.01, 0.10, 0.01],
    "AUTOMATION": [0.09, 0.22, 0.17, 0.10, 0.04, 0.08, 0.03, 0.03, 0.05, 0.01, 0.17, 0.01],
    "CONTENT_GENERATION": [0.18, 0.03, 0.05, 0.05, 0.08, 0.02, 0.09, 0.01, 0.01, 0.21, 0.01, 0.26],
    "HEALTHCARE": [0.34, 0.22, 0.13, 0.07, 0.10, 0.06, 0.04, 0.01, 0.01, 0.00, 0.02, 0.00],
    "LEGAL": [0.33, 0.20, 0.15, 0.07, 0.08, 0.05, 0.04, 0.03, 0.02, 0.01, 0.01, 0.01],
    "HR_RECRUITING": [0.28, 0.13, 0.15, 0.09, 0.08, 0.05, 0.09, 0.00, 0.03, 0.03, 0.02, 0.05],
    "DATA_ANALYSIS": [0.16, 0.23, 0.21, 0.05, 0.06, 0.07, 0.07, 0.03, 0.02, 0.01, 0.01, 0.08],
    "ECOMMERCE_SALES": [0.23, 0.13, 0.17, 0.10, 0.06, 0.05, 0.07, 0.02, 0.08, 0.01, 0.04, 0.04],
    "SECURITY_ITOPS": [0.30, 0.22, 0.15, 0.04, 0.06, 0.05, 0.04, 0.02, 0.04, 0.01, 0.07, 0.00],
    "DEVOPS_SRE": [0.23, 0.16, 0.22, 0.04, 0.05, 0.08, 0.04, 0.03, 0.06, 0.02, 0.06, 0.01],
    "GENERAL": [0.22, 0.18, 0.16, 0.12, 0.04, 0.00, 0.10, 0.08, 0.00, 0.02, 0.06, 0.02],
}

# ---- fixed values: smallest shift worth detecting per use case; .10 for all others -------------
EFFECT_SIZES = {
    "FINANCIAL": 0.05,
    "HEALTHCARE": 0.05,
    "LEGAL": 0.07,
    "SECURITY_ITOPS": 0.07,
    "AUTOMATION": 0.12,
    "ECOMMERCE_SALES": 0.12,
    "RESEARCH_RAG": 0.15,
    "CONTENT_GENERATION": 0.15,
}
DEFAULT_EFFECT_SIZE = 0.10

# ---- fixed values: use cases whose weights may be mixed ----------------------------------------
COMPATIBLE_USE_CASES = [
    ("AUTOMATION", "CODE_GENERATION"),
    ("AUTOMATION", "DEVOPS_SRE"),
    ("AUTOMATION", "DATA_ANALYSIS"),
    ("RESEARCH_RAG", "DATA_ANALYSIS"),
    ("RESEARCH_RAG", "CONTENT_GENERATION"),
    ("CUSTOMER_SUPPORT", "ECOMMERCE_SALES"),
    ("SECURITY_ITOPS", "DEVOPS_SRE"),
    ("FINANCIAL", "LEGAL"),
    ("HEALTHCARE", "LEGAL"),
    ("HR_RECRUITING", "CUSTOMER_SUPPORT"),
    ("DATA_ANALYSIS", "CONTENT_GENERATION"),
]

# ---- fixed values: words that say nothing about the use case -----------------------------------
GENERIC_WORDS = [
    "tool", "action", "handler", "worker", "job", "task", "step", "node", "stage", "pipeline",
    "process", "execute", "run", "call", "invoke", "trigger", "dispatch", "emit", "fire", "main",
    "entry", "function", "method", "operation", "command", "request", "response",
]

# ---- fixed values: abbreviations in tool names -------------------------------------------------
ABBREVIATIONS = {
    "proc": "process", "chk": "check", "upd": "update", "del": "delete", "ins": "insert",
    "calc": "calculate", "auth": "authenticate", "val": "validate", "verif": "verify",
    "mgmt": "management", "svc": "service", "cfg": "config", "msg": "message",
    "notif": "notification", "err": "error", "req": "request", "resp": "response", "usr": "user",
    "acct": "account", "txn": "transaction", "pmt": "payment", "inv": "invoice", "ord": "order",
    "prod": "product", "cust": "customer", "doc": "document", "img": "image", "vid": "video",
    "rbac": "role", "iam": "access", "k8s": "kubernetes", "infra": "infrastructure",
    "db": "database", "repo": "repository", "env": "environment", "dep": "deployment",
    "sec": "security", "vuln": "vulnerability", "cve": "cve", "scan": "scan", "ml": "model",
    "ai": "model", "llm": "model", "rag": "retrieval", "vec": "vector", "emb": "embedding",
}

# ---- fixed values: (affix, use case) worth one point each --------------------------------------
PREFIX_POINTS = [
    ("search_", "RESEARCH_RAG"), ("search_", "ECOMMERCE_SALES"), ("fetch_", "RESEARCH_RAG"),
    ("query_", "DATA_ANALYSIS"), ("query_", "RESEARCH_RAG"), ("run_", "AUTOMATION"),
    ("run_", "CODE_GENERATION"), ("execute_", "AUTOMATION"), ("execute_", "CODE_GENERATION"),
    ("call_", "AUTOMATION"), ("process_", "AUTOMATION"), ("send_", "AUTOMATION"),
    ("send_", "CUSTOMER_SUPPORT"), ("create_", "AUTOMATION"), ("update_", "AUTOMATION"),
    ("delete_", "AUTOMATION"), ("check_", "SECURITY_ITOPS"), ("check_", "DEVOPS_SRE"),
    ("validate_", "FINANCIAL"), ("validate_", "LEGAL"), ("validate_", "HEALTHCARE"),
    ("verify_", "FINANCIAL"), ("verify_", "LEGAL"), ("analyze_", "DATA_ANALYSIS"),
    ("generate_", "CONTENT_GENERATION"), ("generate_", "CODE_GENERATION"),
    ("extract_", "RESEARCH_RAG"), ("extract_", "LEGAL"), ("parse_", "DATA_ANALYSIS"),
    ("parse_", "AUTOMATION"), ("monitor_", "DEVOPS_SRE"), ("monitor_", "SECURITY_ITOPS"),
    ("deploy_", "DEVOPS_SRE"), ("schedule_", "AUTOMATION"), ("notify_", "AUTOMATION"),
    ("notify_", "CUSTOMER_SUPPORT"), ("lookup_", "CUSTOMER_SUPPORT"),
    ("lookup_", "ECOMMERCE_SALES"), ("recommend_", "ECOMMERCE_SALES"),
    ("classify_", "SECURITY_ITOPS"), ("classify_", "HEALTHCARE"), ("score_", "FINANCIAL"),
    ("score_", "HR_RECRUITING"), ("review_", "LEGAL"), ("review_", "CODE_GENERATION"),
    ("approve_", "FINANCIAL"), ("approve_", "HR_RECRUITING"), ("reject_", "FINANCIAL"),
    ("reject_", "HR_RECRUITING"), ("flag_", "SECURITY_ITOPS"), ("flag_", "FINANCIAL"),
    ("trigger_", "AUTOMATION"), ("trigger_", "DEVOPS_SRE"),
]
SUFFIX_POINTS = [
    ("_api", "AUTOMATION"), ("_tool", "AUTOMATION"), ("_action", "AUTOMATION"),
    ("_handler", "AUTOMATION"), ("_service", "DEVOPS_SRE"), ("_check", "SECURITY_ITOPS"),
    ("_check", "DEVOPS_SRE"), ("_search", "RESEARCH_RAG"), ("_search", "ECOMMERCE_SALES"),
    ("_query", "DATA_ANALYSIS"), ("_report", "DATA_ANALYSIS"), ("_alert", "DEVOPS_SRE"),
    ("_alert", "SECURITY_ITOPS"), ("_event", "AUTOMATION"), ("_message", "CUSTOMER_SUPPORT"),
    ("_message", "AUTOMATION"), ("_email", "AUTOMATION"), ("_email", "CUSTOMER_SUPPORT"),
    ("_review", "LEGAL"), ("_review", "CODE_GENERATION"), ("_analysis", "DATA_ANALYSIS"),
    ("_summary", "RESEARCH_RAG"), ("_summary", "CONTENT_GENERATION"),
]

# ---- fixed values: behaviour rules (use case, signal, comparison, cut, points) -----------------
BEHAVIOUR_RULES = [
    ("CUSTOMER_SUPPORT", "escalation_rate", ">", 0.15, 5),
    ("CUSTOMER_SUPPORT", "resolution_rate", ">", 0.60, 4),
    ("CUSTOMER_SUPPORT", "avg_tool_count", "<", 6.0, 3),
    ("CUSTOMER_SUPPORT", "avg_latency_p95", "<", 3000.0, 2),
    ("CODE_GENERATION", "avg_loop_depth", ">", 3.0, 5),
    ("CODE_GENERATION", "avg_tool_count", ">", 8.0, 4),
    ("CODE_GENERATION", "avg_output_length", ">", 500.0, 3),
    ("CODE_GENERATION", "avg_latency_p95", ">", 4000.0, 2),
    ("RESEARCH_RAG", "avg_output_length", ">", 800.0, 5),
    ("RESEARCH_RAG", "avg_tool_count", ">", 6.0, 4),
    ("RESEARCH_RAG", "avg_latency_p95", ">", 3000.0, 3),
    ("RESEARCH_RAG", "avg_verbosity_ratio", ">", 0.6, 2),
    ("CONTENT_GENERATION", "avg_output_length", ">", 600.0, 5),
    ("CONTENT_GENERATION", "avg_verbosity_ratio", ">", 0.7, 4),
    ("CONTENT_GENERATION", "avg_tool_count", "<", 4.0, 3),
    ("DATA_ANALYSIS", "avg_tool_count", ">", 6.0, 5),
    ("DATA_ANALYSIS", "avg_latency_p95", ">", 3000.0, 4),
    ("DATA_ANALYSIS", "avg_loop_depth", ">", 2.0, 3),
    ("DATA_ANALYSIS", "error_rate", "<", 0.05, 2),
    ("WORKFLOW_ORCHESTRATION", "avg_loop_depth", ">", 4.0, 5),
    ("WORKFLOW_ORCHESTRATION", "avg_retry_rate", ">", 0.10, 4),
    ("WORKFLOW_ORCHESTRATION", "avg_tool_count", ">", 10.0, 3),
    ("WORKFLOW_ORCHESTRATION", "error_rate", ">", 0.05, 2),
    ("REAL_TIME_MONITORING", "avg_latency_p95", "<", 2000.0, 5),
    ("REAL_TIME_MONITORING", "avg_time_to_first_tool", "<", 500.0, 4),
    ("REAL_TIME_MONITORING", "avg_tool_count", "<", 5.0, 3),
    ("REAL_TIME_MONITORING", "avg_loop_depth", "<", 2.0, 2),
    ("TESTING_VALIDATION", "error_rate", ">", 0.10, 5),
    ("TESTING_VALIDATION", "avg_retry_rate", ">", 0.15, 4),
    ("TESTING_VALIDATION", "avg_loop_depth", ">", 3.0, 3),
    ("TESTING_VALIDATION", "fallback_rate", ">", 0.10, 2),
    ("DEBUGGING_TROUBLESHOOTING", "avg_retry_rate", ">", 0.20, 5),
    ("DEBUGGING_TROUBLESHOOTING", "error_rate", ">", 0.15, 4),
    ("DEBUGGING_TROUBLESHOOTING", "avg_loop_depth", ">", 4.0, 3),
    ("DEBUGGING_TROUBLESHOOTING", "fallback_rate", ">", 0.15, 2),
    ("DECISION_SUPPORT", "avg_output_length", ">", 400.0, 4),
    ("DECISION_SUPPORT", "avg_verbosity_ratio", ">", 0.5, 3),
    ("DECISION_SUPPORT", "avg_tool_count", ">", 4.0, 3),
    ("DECISION_SUPPORT", "avg_latency_p95", ">", 2500.0, 2),
    ("TASK_AUTOMATION", "avg_loop_depth", ">", 2.0, 4),
    ("TASK_AUTOMATION", "avg_tool_count", ">", 5.0, 4),
    ("TASK_AUTOMATION", "avg_retry_rate", "<", 0.05, 3),
    ("TASK_AUTOMATION", "error_rate", "<", 0.05, 2),
    ("SYNTHETIC_DATA_GENERATION", "avg_output_length", ">", 500.0, 5),
    ("SYNTHETIC_DATA_GENERATION", "avg_tool_count", "<", 3.0, 4),
    ("SYNTHETIC_DATA_GENERATION", "avg_verbosity_ratio", ">", 0.65, 3),
    ("AGENT_ORCHESTRATION", "avg_loop_depth", ">", 5.0, 5),
    ("AGENT_ORCHESTRATION", "avg_tool_count", ">", 12.0, 4),
    ("AGENT_ORCHESTRATION", "avg_retry_rate", ">", 0.10, 3),
    ("AGENT_ORCHESTRATION", "avg_latency_p95", ">", 5000.0, 2),
]

# ---- fixed values: hypothesis rules (bounds left out do not bind) ------------------------------
HYPOTHESIS_RULES = [
    {
        "rule_id": "escalation_more",
        "decision_drift_min": 0.5,
        "escalation_rate_delta_min": 0.08,
        "observation": "Agent is escalating significantly more than baseline.",
        "likely_cause": "Prompt or threshold changes, or model behaving more cautiously; task mix may favor edge cases.",
        "recommended_action": "Review escalation triggers and recent prompt/model changes. Check if higher escalation is acceptable or tighten resolution paths.",
    },
    {
        "rule_id": "escalation_less",
        "decision_drift_min": 0.5,
        "escalation_rate_delta_max": -0.03,
        "observation": "Agent is escalating significantly less than baseline.",
        "likely_cause": "Model or prompt change favoring resolution; possible over-confidence or reduced sensitivity to edge cases.",
        "recommended_action": "Confirm that lower escalation is intended. If not, restore or tighten escalation conditions and review resolution quality.",
    },
    {
        "rule_id": "tool_decrease",
        "tool_decrease_min_pct": 40.0,
        "observation": "Tool '{{tool_name}}' is being used much less (down {{delta_pct}}% vs baseline).",
        "likely_cause": "Prompt or model change bypassing this tool; fewer tasks requiring it; or new fallback path.",
        "recommended_action": "Review recent changes that might reduce {{tool_name}} usage. Ensure the tool is still invoked when needed.",
    },
    {
        "rule_id": "tool_increase",
        "tool_increase_min_pct": 100.0,
        "observation": "Tool '{{tool_name}}' is being used much more (up {{delta_pct}}% vs baseline).",
        "likely_cause": "Agent over-relying on this tool; task mix shift; or escalation/search behavior increased.",
        "recommended_action": "Confirm whether increased {{tool_name}} use is intended. If not, tighten instructions or add guardrails.",
    },
    {
        "rule_id": "latency_slow",
        "latency_drift_min": 0.4,
        "tool_drift_max": 0.1,
        "observation": "Behavior is similar (tool usage stable) but latency is significantly higher.",
        "likely_cause": "Slower model or APIs, more reasoning steps, or infrastructure/load; tool mix unchanged.",
        "recommended_action": "Profile per-tool and model latency. Consider caching, simpler flows, or capacity scaling.",
    },
    {
        "rule_id": "error_drift",
        "error_drift_min": 0.3,
        "observation": "Error rate has increased significantly vs baseline.",
        "likely_cause": "New failures (timeouts, validation, API errors) or more aggressive retries exposing edge cases.",
        "recommended_action": "Inspect error types in runs and logs. Fix or relax validations and timeouts as needed.",
    },
    {
        "rule_id": "decision_only_drift",
        "decision_drift_min": 0.3,
        "tool_drift_max": 0.1,
        "observation": "Decision outcomes (resolved/escalated/fallback) changed but tool usage is stable.",
        "likely_cause": "Prompt or model changes affecting when the agent escalates or resolves, without changing tool choice.",
        "recommended_action": "Compare prompts and system instructions between baseline and current. Check escalation and resolution thresholds.",
    },
    {
        "rule_id": "stable",
        "overall_drift_max": 0.05,
        "observation": "Overall drift is low; behavior is stable.",
        "likely_cause": "No significant change in tool usage, decisions, latency, or errors.",
        "recommended_action": "No action required. Continue monitoring.",
    },
]

# ---- fixed values: dimensions each kind of change can explain ----------------------------------
CHANGE_DIMS = {
    "model_version": ["decision_drift", "error_rate", "tool_sequence", "semantic_drift", "verbosity_ratio", "output_length"],
    "prompt_hash": ["decision_drift", "semantic_drift", "verbosity_ratio", "output_length", "tool_sequence"],
    "rag_snapshot": ["semantic_drift", "output_length", "tool_sequence"],
    "tool_version": ["error_rate", "tool_sequence", "latency", "retry_rate"],
}

# ---- fixed values: advice on the change that explains a drift, by its type ---------------------
ADVICE = {
    "model_version": 'Pin model version explicitly in your API call to isolate whether this is model-induced. Compare: model="{previous}" vs model="{current}"',
    "model_version, one side": "Pin model version explicitly in your API call to isolate model-induced drift",
    "prompt_hash": "Review the system prompt diff between versions. Even small wording changes can shift decision distributions significantly.",
    "rag_snapshot": "Compare the document sets in each RAG snapshot. New or removed documents directly affect retrieval behavior and output content.",
    "tool_version": "Check the changelog for the tool between the two versions. Tool behavior changes are a common source of sequence and error drift.",
    "custom": "Review the recorded change ({type}={current}) and assess whether it could affect agent decision logic.",
    "other": "Review the recorded change and assess its impact on agent behavior.",
    "nothing changed": "No changes detected between versions despite having recorded change events.",
    "nothing recorded": "Record change events at deploy time to enable root cause analysis.",
}

# ---- fixed values: budget keys and the quantity each one limits --------------------------------
BUDGET_KEYS = {
    "max_p95_latency": "latency_p95",
    "max_p50_latency": "latency_p50",
    "max_error_rate": "error_rate",
    "max_escalation_rate": "decision_drift",
    "min_resolution_rate": "decision_drift",
    "max_retry_rate": "retry_rate",
    "max_loop_depth": "loop_depth",
    "max_verbosity_ratio": "verbosity_ratio",
    "max_output_length": "output_length",
    "max_time_to_first_tool": "time_to_first_tool",
}

# ---- fixed values: words that mark an escalated outcome ----------------------------------------
ESCALATION_WORDS = [
    "escalat", "transfer", "human agent", "supervisor", "unable to", "cannot help",
    "out of scope", "specialist", "need help", "can't handle",
]

# ---- fixed values: names that are not tools in an observation tree -----------------------------
NON_TOOL_NAMES = ["llm", "chain", "agent", "root", "trace", "trace_root"]

# ---- fixed values: industry benchmarks (benchmark, metric, value) ------------------------------
BENCHMARKS = [
    ("rag-pipeline", "p50_latency", 450.0), ("rag-pipeline", "p95_latency", 800.0),
    ("rag-pipeline", "p99_latency", 1200.0), ("rag-pipeline", "avg_prompt_tokens", 650.0),
    ("rag-pipeline", "avg_completion_tokens", 120.0), ("rag-pipeline", "tool_call_count", 5.0),
    ("rag-pipeline", "error_rate", 0.02), ("rag-pipeline", "escalation_rate", 0.03),
    ("customer-support", "p50_latency", 350.0), ("customer-support", "p95_latency", 650.0),
    ("customer-support", "p99_latency", 1000.0), ("customer-support", "avg_prompt_tokens", 450.0),
    ("customer-support", "avg_completion_tokens", 90.0), ("customer-support", "tool_call_count", 4.0),
    ("customer-support", "error_rate", 0.03), ("customer-support", "escalation_rate", 0.12),
    ("code-generation", "p50_latency", 2000.0), ("code-generation", "p95_latency", 4500.0),
    ("code-generation", "p99_latency", 7000.0), ("code-generation", "avg_prompt_tokens", 1500.0),
    ("code-generation", "avg_completion_tokens", 450.0), ("code-generation", "tool_call_count", 6.0),
    ("code-generation", "error_rate", 0.08), ("code-generation", "escalation_rate", 0.05),
    ("research-agent", "p50_latency", 1200.0), ("research-agent", "p95_latency", 2500.0),
    ("research-agent", "p99_latency", 4000.0), ("research-agent", "avg_prompt_tokens", 1000.0),
    ("research-agent", "avg_completion_tokens", 200.0), ("research-agent", "tool_call_count", 6.0),
    ("research-agent", "error_rate", 0.04), ("research-agent", "escalation_rate", 0.08),
]

# ---- fixed values: rate cards per million tokens -----------------------------------------------
RATE_CARDS = {
    "enterprise": (1.80, 7.50),
    "standard": (2.50, 10.00),
    "budget": (0.50, 1.50),
}

# ---- fixed values: cuts and options ------------------------------------------------------------
COMPOSITE_CUTS = {"MONITOR": 0.15, "REVIEW": 0.28, "BLOCK": 0.42}
SENSITIVITY = {"strict": 0.75, "standard": 1.0, "relaxed": 1.35}
THRESHOLD_PROBS = {"MONITOR": 0.9772, "REVIEW": 0.9987, "BLOCK": 0.99997}
Z_ALPHA = 1.959963985
Z_BETA = 0.841621234
CHI2_CRITICAL = {1: 3.84, 2: 5.99, 3: 7.81, 4: 9.49, 5: 11.07, 6: 12.59, 7: 14.07, 8: 15.51, 9: 16.92, 10: 18.31}
TIER1_MIN = 15
TIER2_MIN = 50
BOOTSTRAP_ROUNDS = 500
# Steps of the Poisson(1) distribution, scaled to 32 bits.
POISSON_CUTS = [int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]
BOOTSTRAP_CAP = 200
TEXT_LIMIT = 102400
EPOCH_CUT = 0.15
EPOCH_WINDOW = 20
EPOCH_MIN_RUNS = 40
DRIFT_THRESHOLD = 0.20
SEED = 42
