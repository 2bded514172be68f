"""allelix: PySpark-first population-genomics analytics, with training-data operators in ``allelix.llm``."""
