"""Training-data operators: ten corpus operators for web-scale text, each in its own module.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it can be imported.
"""
