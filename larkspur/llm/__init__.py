"""Training-data operators over `documents`-shaped tables.

Nothing else in the library imports this package; `__spark_entry__.py` adds its queries when it is there.
"""
