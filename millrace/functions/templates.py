"""Wording of questions and answers. All of it is a parameter of the operators; this is the default."""

from __future__ import annotations

# Layouts and response formats.
ASSOCIATION = "{question}\n\n(A) {a}\n(B) {b}\n(C) {c}\n(D) {d}{format}\n"
CONSISTENCY = "{question}\n\n{subject}: {text}{format}\n"
COUNT_FORMAT = "\nAnswer the question using a single integer number."
LETTER_FORMAT = "\nAnswer with the option's letter from the given choices directly."
WORD_FORMAT = "\nAnswer the question with a single word."

#: What a diagram of a lookup key is called, and how its parts are.
NOUNS = {
    "spice": "circuit",
    "verilog": "digital circuit",
    "logic_bool": "logic circuit",
    "qasm": "quantum circuit",
    "newick": "phylogenetic tree",
    "vienna": "secondary structure",
    "fasta": "alignment",
    "fasta_seq": "sequence logo",
    "smiles": "molecule",
    "nn_keras": "network",
    "nn_onnx_graph": "network",
    "fen": "chess position",
    "abc": "score",
    "uml": "diagram",
    "gantt": "timeline",
    "mind": "mind map, its root left out,",
    "dbml": "database schema",
    "rdf_xml": "knowledge graph",
}
PARTS = {
    "logic_bool": "{component} gates",
    "vienna": "'{component}' bases",
    "fasta": "'{component}' bases",
    "fasta_seq": "sequences",
    "nn_keras": "{component} layers",
    "nn_onnx_graph": "{component} layers",
    "abc": "'{component}' notes",
}
ASKED = ["How many {part} does this {noun} show?", "Count all {part} of this {noun}.", "Give the number of {part} in this {noun}.", "What number of {part} has this {noun}?"]

STRUCTURAL = {key: [x.replace("{part}", PARTS.get(key, "{component}")).replace("{noun}", noun) for x in ASKED] for key, noun in NOUNS.items()}

QUESTIONS = {
    "persona": ["Which of these personas would work with what the picture shows?", "Pick the persona whose work this picture belongs to.", "Whose task could this visualization come from?"],
    "caption": ["Which of these captions belongs to the picture?", "Pick the caption that fits what is shown.", "Which caption was written for this visualization?"],
    "problem": ["Does the picture solve the problem below?", "Was this visualization made for the following problem?", "Is what is shown an answer to this problem statement?"],
    "description": ["Does the text below describe what the picture shows?", "Is this description one of the visualization?", "Do the picture and the following description agree?"],
    "describe": ["Describe what the picture shows and what it is for.", "Explain how the parts of this visualization work together.", "What does this visualization represent?"],
    "captioning": ["Write a caption for this picture.", "Which caption would suit this visualization?", "Give a caption that says what is shown."],
    "code": ["Write the code behind this visualization.", "Turn this picture into code.", "Which code gives this diagram?"],
}
ANSWERS = {
    "structural": ["{cnt}\nThe picture shows {cnt} {component}.", "{cnt}\nThere are {cnt} {component}.", "{cnt}\nIn total {cnt} {component} can be seen."],
    "association": ["{answer}\nThe picture shows a {category}, and {answer} is the {subject} that belongs to it.", "{answer}\nOf the options, {subject} {answer} fits, as this is a {category}."],
    "none": ["None\nThe picture shows a {category}, to which no {subject} listed belongs.", "None\nThis is a {category}; none of the options is its {subject}."],
    "consistency": ["{answer}\n{answer}, this {category} does {neg}match the {subject}.", "{answer}\n{answer}, the {subject} is {neg}what this {category} shows."],
    "code": ["This is the code in {language}.", "In {language} it can be written so:"],
}
