import importlib.util

if importlib.util.find_spec("fernglass.llm") is None:
    collect_ignore_glob = ["test_*.py"]
