"""Texts, patterns and tables that results must agree on."""

# fixed values: lines of a question that only instruct how to answer
INSTRUCTION_PHRASES = (
    "please reason step by step",
    "solve the following math problem step by step",
    "remember to put your answer",
    "put your final answer",
    "the last line of your response",
)
INSTRUCTION_LINE = "(?i)(?:" + "|".join(INSTRUCTION_PHRASES) + ")"

# fixed values: the instruction that a prompt ends with
STEP_BY_STEP = "Please reason step by step"
PROMPT_SUFFIX = "\nPlease reason step by step, and put your final answer within \\boxed{}."

# fixed values: the protocol's markers
ACTION_MARKERS = ("<ASK>", "<VERIFY>", "<ACCEPT>")
HELP = ("<TEACHER_HELP>", "</TEACHER_HELP>")
REVIEW = ("<TEACHER_REVIEW>", "</TEACHER_REVIEW>")
NOTICE = ("<ENVIRONMENT_NOTICE>", "</ENVIRONMENT_NOTICE>")
CONTEXT_MARKERS = (*HELP, *REVIEW, *NOTICE)
CONTROL_MARKER = r"(?i)</?(?:ASK|VERIFY|ACCEPT|TEACHER_HELP|TEACHER_REVIEW|ENVIRONMENT_NOTICE)>"

# fixed values: policies of traces and the reason that names the first
INTERACTION_POLICY = "hsp"
RELAY_POLICY = "relay_call"
OTHER_POLICY_REASON = "non_hsp"

# fixed values: sample types with their weights, in order
SAMPLE_WEIGHTS = {
    "normal": 0.45,
    "ask_help": 0.15,
    "verify_confirm": 0.10,
    "verify_accept_correction": 0.15,
    "verify_reject_bad_feedback": 0.10,
    "verify_uncertain": 0.05,
}
SAMPLE_TYPES = tuple(SAMPLE_WEIGHTS)

# fixed values: token budgets that requests ask for
ASK_BUDGETS = (32, 64, 96, 128)
VERIFY_BUDGETS = (64, 96, 128)

# fixed values: difficulty bins, easiest last
DIFFICULTY_BINS = ("0", "(0,0.25]", "(0.25,0.5]", "(0.5,0.75]", "(0.75,1)", "1")

# fixed values: replacements in a final answer, in order
ANSWER_REPLACED = (
    ("an ", ""),
    ("a ", ""),
    (".$", "$"),
    ("\\$", ""),
    ("\\ ", ""),
    (" ", ""),
    ("mbox", "text"),
    (",\\text{and}", ","),
    ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
)

# fixed values: expressions that a final answer loses, in order
ANSWER_REMOVED = (
    "square",
    "ways",
    "integers",
    "dollars",
    "mph",
    "inches",
    "hours",
    "km",
    "units",
    "\\ldots",
    "sue",
    "points",
    "feet",
    "minutes",
    "digits",
    "cents",
    "degrees",
    "cm",
    "gm",
    "pounds",
    "meters",
    "meals",
    "edges",
    "students",
    "childrentickets",
    "multiples",
    "\\text{s}",
    "\\text{.}",
    "\\text{\ns}",
    "\\text{}^2",
    "\\text{}^3",
    "\\text{\n}",
    "\\text{}",
    "\\mathrm{th}",
    "^\\circ",
    "^{\\circ}",
    "\\;",
    ",\\!",
    "{,}",
    '"',
    "\\dots",
)
