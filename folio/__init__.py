"""A PySpark engine for collections of PDF documents."""
