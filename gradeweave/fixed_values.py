"""Texts, patterns and defaults that outputs must match exactly."""

# --- fixed values: question text (section headings, each section ends without a newline)
QUESTION_HEAD = "Problem:\n"
QUESTION_INPUT = "\nInput Format:\n"
QUESTION_OUTPUT = "\nOutput Format:\n"
QUESTION_NOTES = "\nNotes:\n"
QUESTION_SAMPLES = "\nSample Test Cases:\n"
SAMPLE_HEAD = "\nExample "
SAMPLE_INPUT = "Input:\n"
SAMPLE_OUTPUT = "Output:\n"
SAMPLE_EXPLANATION = "Explanation:\n"
STARTER_HEAD = "\nStarter Code:\n```python\n"
STARTER_TAIL = "\n```\n"

# --- fixed values: generation prompt
PROMPT_TASK = (
    "You will be given a question (problem specification) and will generate a correct "
    "Python program that matches the specification and passes all tests."
)
PROMPT_ONLY_PROGRAM = " You will NOT return anything except for the program."
PROMPT_QUESTION = "\nQuestion: "
PROMPT_FUNCTION_TAIL = (
    "\n\nYou will use the following starter code to write the solution to the problem "
    'and enclose your code within delimiters."\n```python\n'
)
PROMPT_STDIN_TAIL = (
    "\n\nRead the inputs from stdin solve the problem and write the answer to stdout "
    "(do not directly test on the sample inputs). Enclose your code within delimiters as "
    "follows. Ensure that when the python program runs, it reads the inputs, runs the "
    "algorithm and writes output to STDOUT.\n```python\n  # YOUR CODE HERE\n```"
)

# --- fixed values: model names that think before answering (any part, any case)
THINKING_MODEL_PARTS = ("qwq", "deepseek-r1", "r1-distill", "thinking")

# --- fixed values: ranking prompt and record constants
RANKING_BEFORE_COUNT = "You will be given a question (problem specification) and "
RANKING_AFTER_COUNT = (
    " candidate solutions. You will analyze these candidates and RANK them from most "
    "likely to least likely to pass all tests. You will NOT return anything except for "
    "the ranking.\n\nQuestion: "
)
RANKING_TAIL = (
    "\n\nAnalyze each candidate solution, analyze all the strengths and weaknesses, and "
    "rank them from most effective to least effective. Output ONLY the ranking as "
    'comma-separated numbers from best to worst (e.g., "2, 4, 1, 3").\n\n'
    "Ranking (best to worst): "
)
CANDIDATE_HEAD = "--- CANDIDATE "
CANDIDATE_OPEN = " ---\n```python\n"
CANDIDATE_CLOSE = "\n```\n"
RECORD_KIND = "code_ranking"
REWARD_STYLE = "rule"

# --- fixed values: end of a thinking trace, and a number short enough for a candidate id
THINK_END = "</think>"
SHORT_NUMBER = "(?<![0-9])[0-9]{1,4}(?![0-9])"

# --- fixed values: characters that count as white space (those of Python's str.strip)
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: fenced code, tagged first, then bare
TAGGED_FENCE = r"(?s)```python[" + WHITESPACE + r"]*\n(.*?)\n```"
BARE_FENCE = r"(?s)```[" + WHITESPACE + r"]*\n(.*?)\n```"

# --- fixed values: columns of the generated table
OUTPUTS = "self_distillation_outputs"
FINISH_REASONS = "self_distillation_finish_reasons"
PASS_RATES = "self_distillation_pass_rates"

# --- fixed values: evaluation result files
TASK_NAME_PARTS = ("LiveCodeBench", "BigCodeBench", "CodeForces")
FLAT_RESULT_KEYS = ("accuracy", "pass_at_1", "ndcg")

# --- fixed values: default parameters
MAX_TOKENS = 131072
PROMPT_SHARE = 0.8
CHARS_PER_TOKEN = 3
MAX_TESTS = 50
GROUP_SIZE = 4
MAX_PASS_RATIO = 1.0
VAL_RATIO = 0.1
SPLIT_SEED = 42
MAX_PROMPT_TOKENS = 32768

# Metrics that a summary shows, in this order; without any, so many by name.
SHOWN_METRICS = ("accuracy", "accuracy_easy", "accuracy_medium", "accuracy_hard", "pass_at_1")
SHOWN_OTHERS = 5
