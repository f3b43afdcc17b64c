"""Word lists of the catalog's labels. All are fixed values: labels and patterns that results depend on."""

PRIMITIVES = {
    "Zero-Copy": [r"\bzero-copy\b", r"\bzero copy\b", r"\bmmap\b", r"\bkernel bypass\b"],
    "SIMD / Vectorized": [r"\bsimd\b", r"\bvectorized\b", r"\bavx-?512\b", r"\bavx2\b", r"\bneon\b"],
    "WASM / WASI": [r"\bwasm\b", r"\bwebassembly\b", r"\bwasi\b"],
    "Raft Consensus": [r"\braft\b", r"\bpaxos\b", r"\bconsensus\b", r"\betcd\b"],
    "LSM-Tree / B-Tree": [r"\blsm\b", r"\blsm-tree\b", r"\bb-tree\b", r"\brocksdb\b", r"\bwal\b", r"\bwrite-ahead\b"],
    "eBPF / Kernel": [r"\bebpf\b", r"\bxdp\b", r"\bbpf\b", r"\bkernel module\b"],
    "CUDA / GPU Accelerated": [r"\bcuda\b", r"\bgpu\b", r"\btensorrt\b", r"\brocm\b", r"\bmetal\b"],
    "Lock-Free / Concurrency": [r"\block-free\b", r"\bconcurrency\b", r"\bthread-safe\b", r"\bchannel\b", r"\bactor model\b", r"\basync\b"],
    "HNSW / Vector Index": [r"\bhnsw\b", r"\bann\b", r"\bfaiss\b", r"\bivf\b", r"\bcosine similarity\b"],
    "Memory-Mapped / In-Memory": [r"\bin-memory\b", r"\bram\b", r"\bcache\b", r"\bmemcached\b", r"\bmcache\b"],
    "Columnar Storage": [r"\bcolumnar\b", r"\bparquet\b", r"\barrow\b", r"\bcolumn-oriented\b"],
    "AST / Parser Engine": [r"\bast\b", r"\bparser\b", r"\blexer\b", r"\btokeniz\b", r"\btree-sitter\b"],
    "Quantization (GGUF/GPTQ)": [r"\bgguf\b", r"\bquantiz\b", r"\bgptq\b", r"\bawq\b", r"\b4-bit\b", r"\b8-bit\b"],
}
COMPATIBILITY = {
    "PostgreSQL Compatible": [r"\bpostgres\b", r"\bpostgresql\b", r"\bpgwire\b", r"\bpg_dump\b"],
    "Redis Compatible": [r"\bredis\b", r"\bredis-cli\b", r"\bresp\b"],
    "Kubernetes Native": [r"\bkubernetes\b", r"\bk8s\b", r"\bhelm\b", r"\bcrd\b", r"\boperator\b"],
    "OpenTelemetry Native": [r"\bopentelemetry\b", r"\botel\b", r"\bjaeger\b", r"\btracing\b"],
    "Docker / OCI Compliant": [r"\bdocker\b", r"\boci\b", r"\bcontainerd\b"],
    "Prometheus Native": [r"\bprometheus\b", r"\bmetrics\b", r"\balertmanager\b"],
    "S3 API Compatible": [r"\bs3\b", r"\bminio\b", r"\bblob storage\b", r"\bobject storage\b"],
    "OpenAPI / REST": [r"\bopenapi\b", r"\bswagger\b", r"\brest\b", r"\brestful\b"],
    "gRPC / Protobuf": [r"\bgrpc\b", r"\bprotobuf\b", r"\bproto\b"],
    "GraphQL Native": [r"\bgraphql\b", r"\bapollo\b"],
    "OpenAI API Compatible": [r"\bopenai api\b", r"\bopenai-compatible\b", r"\bchat completions\b"],
}
USE_CASES = {
    "Edge & Offline Computing": [r"\bedge\b", r"\boffline\b", r"\biot\b", r"\bembedded\b", r"\blocal-first\b"],
    "High-Throughput Analytics": [r"\banalytics\b", r"\bolap\b", r"\bbig data\b", r"\bthroughput\b", r"\bstreaming\b"],
    "Local LLM Inference": [r"\blocal ai\b", r"\blocal llm\b", r"\bself-hosted llm\b", r"\brun locally\b"],
    "Cloud Native Infrastructure": [r"\bcloud native\b", r"\bcloud-native\b", r"\bmulti-cloud\b", r"\bmicroservices\b"],
    "Autonomous Agent Systems": [r"\bagents\b", r"\bagentic\b", r"\bworkflow\b", r"\brag\b", r"\btool use\b"],
    "Zero Trust & Compliance": [r"\bzero trust\b", r"\bcompliance\b", r"\bsbom\b", r"\baudit\b", r"\bvulnerability\b"],
}
#: Patterns by which the other side is known as a client of a protocol.
PROTOCOL_CLIENTS = {
    "PostgreSQL Compatible": r"\bpsycopg\b|\bpgx\b|\bnode-postgres\b|\blibpq\b|\bpgdriver\b|\bpostgres[-_ ]?js\b",
    "OpenAI API Compatible": r"\bopenai\b|\blitellm\b|\bllm[-_ ]?client\b",
    "Redis Compatible": r"\biredis\b|\bredis[-_ ]?py\b|\bjedis\b|\blettuce\b|\bgo[-_ ]?redis\b",
    "gRPC / Protobuf": r"\bgrpc\b|\bprotobuf\b",
    "GraphQL Native": r"\bgraphql[-_ ]?yoga\b|\bapollo[-_ ]?client\b|\burql\b",
}
CURATED_PATTERNS = [
    r"^awesome-", r"-awesome$", r"\bawesome list\b", r"\bcurated list\b", r"\bresources list\b", r"\bcheatsheet\b", r"\broadmap\b",
    r"\binterview-questions\b", r"\bstudy plan\b", r"\bbuild your own\b",
]
CURATED_TAGS = ["awesome", "awesome-list", "roadmap", "cheatsheet", "reading-list", "learning", "tutorial", "checklist"]
#: Artifact labels in the order that breaks ties; the last is the default.
ARTIFACTS = [
    "Curated List / Docs", "Template / Starter", "Developer Tool / CLI", "Library / SDK", "System Service / Engine", "Framework",
    "Application / Service",
]
#: label -> (keywords, weight in the name, weight elsewhere).
ARTIFACT_EVIDENCE = {
    "Template / Starter": [(["template", "boilerplate", "starter", "scaffold", "cookiecutter"], 6, 3)],
    "Developer Tool / CLI": [
        (["cli", "tui"], 6, 5),
        (["command line tool", "command line interface", "terminal emulator", "version control", "infrastructure as code"], 4, 4),
        (["bundler", "linter", "formatter", "profiler", "debugger", "scanner", "compiler", "transpiler"], 4, 3),
        (["iac", "codegen", "code generator"], 4, 4),
    ],
    "Library / SDK": [(["library", "sdk", "bindings"], 5, 4), (["client", "driver", "wrapper"], 4, 3), (["extension"], 0, 3)],
    "System Service / Engine": [
        (["daemon"], 4, 4), (["broker"], 4, 3), (["scheduler"], 4, 2), (["database server"], 4, 3), (["engine", "server"], 2, 2),
        (["database", "datastore", "in-memory", "store"], 1, 1),
    ],
    "Framework": [(["framework"], 6, 5)],
}
