"""Entry-function name of starter code: the one place that needs Python's own parser."""

import ast
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Send this module's functions with the job: workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: The last line that is not blank, if it ends in a colon; the group is what it is indented by.
OPEN_BLOCK = re.compile(r"^([^\S\n]*)(?=\S).*:\s*\Z", re.MULTILINE)


class DeepestFunction(ast.NodeVisitor):
    """Of the functions nested deepest in the syntax tree, the name of the last one."""

    def __init__(self):
        self.level, self.found_at, self.name = 0, -1, None

    def visit_FunctionDef(self, node):
        if self.level >= self.found_at:
            self.found_at, self.name = self.level, node.name
        self.generic_visit(node)

    def generic_visit(self, node):
        self.level += 1
        super().generic_visit(node)
        self.level -= 1


def entry_name(code: str | None) -> str | None:
    """Name of the entry function; null for none, and for code that Python cannot parse.

    A block that is still open at the end of the text is given a body.
    """
    if not code:
        return None
    block = OPEN_BLOCK.search(code)
    body = f"\n{'':{len(block[1]) + 4}}..." if block else ""
    visitor = DeepestFunction()
    try:
        visitor.visit(ast.parse(code + body))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    return visitor.name


@F.pandas_udf(StringType())
def _entry_names(codes: pd.Series) -> pd.Series:
    known = {code: entry_name(code) for code in codes.dropna().unique()}
    return codes.map(known).astype(object)


def entry_function_name(starter_code: Column) -> Column:
    """Each distinct text is parsed once per Arrow batch, so equal texts need no shuffle."""
    return _entry_names(starter_code)
