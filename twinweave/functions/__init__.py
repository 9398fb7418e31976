"""Column functions: vectors, names and paths, display texts. All are built-in expressions without Python on the executors."""
