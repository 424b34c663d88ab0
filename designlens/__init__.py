"""designlens: mining of large combinatorial design spaces with PySpark."""
