"""Column functions: Column(s) in, Column out. All of them are built-in JVM expressions."""
