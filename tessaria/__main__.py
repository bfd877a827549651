from tessaria.cli import main

main()
