"""Where rows and statistics come from and go to."""
