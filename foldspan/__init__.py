"""foldspan: Spark jobs for protein-engineering evidence, structures, designs and training text."""
