"""skein: repository analytics as PySpark DataFrame operators."""
