"""Where rows and manifests come from and go to."""
