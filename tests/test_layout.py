"""Test modules must not import from ``conftest``: there are several, and which one is found depends on what is collected."""

import ast
from pathlib import Path


def test_no_module_imports_conftest():
    for file in Path(__file__).parent.rglob("*.py"):
        for node in ast.walk(ast.parse(file.read_text())):
            if isinstance(node, ast.ImportFrom):
                assert node.module != "conftest", file
            if isinstance(node, ast.Import):
                assert all(a.name != "conftest" for a in node.names), file
