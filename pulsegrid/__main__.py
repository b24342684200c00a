from pulsegrid.cli import main

main()
