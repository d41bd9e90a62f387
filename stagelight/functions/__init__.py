"""Column functions; native expressions unless a docstring says otherwise."""
