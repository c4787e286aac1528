"""Fixed values that results depend on."""

# Categories and languages that the quality filter admits.
ALLOWED = {
    "circuit": ["spice"],
    "hdl": ["verilog"],
    "logic": ["logic_bool"],
    "quantum": ["qasm"],
    "tree": ["newick"],
    "dna": ["fasta", "vienna"],
    "mol": ["smiles", "smarts_react"],
    "neural": ["nn_onnx_graph"],
    "chess": ["fen"],
    "music": ["abc"],
    "class": ["puml"],
    "sequence": ["puml"],
    "bpmn": ["bpmn"],
    "gantt": ["mermaid"],
    "sql": ["dbml"],
    "mind": ["mermaid"],
    "kg": ["rdf_xml"],
    "chart": ["plotly"],
    "table": ["plotly"],
}

# Domain of a language (of the category for puml and mermaid).
DOMAINS = {
    "electrical": ["spice", "verilog", "logic_symb", "logic_bool", "qasm"],
    "biology": ["newick", "vienna", "fasta"],
    "chemistry": ["smiles", "smarts_react"],
    "computer": ["nn_keras", "nn_onnx_graph", "rdf_xml"],
    "art": ["fen", "abc", "xml"],
    "system": ["class", "sequence", "activity", "component", "dbml", "scxml", "state"],
    "business": ["bpmn", "gantt", "mind"],
}

# Languages whose category stands for them in lookups.
BY_CATEGORY = ["puml", "mermaid"]

# Widest aspect ratio of a category; all others 3.
RATIOS = {"music": 7.0, "dna": 7.0, "neural": 4.0, "gantt": 4.0, "quantum": 3.5, "logic": 3.5}
RATIO = 3.0

# Node kinds that no question asks for.
SILENT_NODES = [
    "activations",
    "deactivations",
    "labeled_transitions",
    "end_transitions",
    "start_transitions",
    "start_events",
    "end_events",
    "conditional_flows",
]

# Languages measured in characters, not lines.
CHARACTER_LANGUAGES = ["logic_bool", "logic_symb", "newick", "fasta", "vienna", "smiles", "smarts", "smarts_react", "fen", "abc"]

# Lookup keys that share the general diagram questions.
UML_KEYS = ["class", "sequence", "activity", "component", "usecase", "state", "requirement", "bpmn", "plotly"]

COMPLEXITIES = ["low", "medium", "high"]
LETTERS = ["A", "B", "C", "D"]

# Token repair.
START_TOKEN, END_TOKEN, OPEN_TOKEN = 200007, 200002, 200006
